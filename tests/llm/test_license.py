import math
import random
import re
import textwrap
from collections import Counter

from sparkloom.llm.license import TEMPLATES, header_of, scan_licenses
from sparkloom.llm.license_texts import HEADERS, OPENINGS, TEXTS

NEGATIONS = "not no never neither nor isn aren wasn weren cannot".split()


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))


def line_units(t):
    """Each sentence of each line, then each sentence of a paragraph that is wrapped: ``(set of line parts, text)``."""
    n = 0
    for paragraph in re.split(r"\n[ \t]*\n\s*", t):
        parts = [p for line in re.split(r"[\r\n]+", paragraph) for p in re.split(r"(?<=[.!?])[ \t]+", line)]
        yield from (({n + i}, p) for i, p in enumerate(parts))
        run = []
        for i, p in enumerate(parts):
            run.append(i)
            if re.search(r"[.!?:]\s*$", p) or i == len(parts) - 1:
                if len(run) > 1:
                    yield {n + j for j in run}, " ".join(re.sub(r"^\s*(/\*+|\*+/?|//+|#+)?\s*|\s*\*+/\s*$", "", parts[j]) for j in run)
                run = []
        n += len(parts)


def plain(files, threshold=0.75, text_threshold=0.85, file_share=0.5):
    df = Counter(w for _, _, t in files for w in set(words(t or "")))
    vocab = {w for _, t in (*TEMPLATES, *HEADERS, *TEXTS, *OPENINGS) for w in words(t)}

    def best(templates, ws, least):
        own = {w for _, t in templates for w in words(t)}
        idf = lambda w: math.log((1 + len(files)) / (1 + (df[w] if w in own else 0))) + 1
        vec = lambda ws: {w: n * idf(w) for w, n in Counter(ws).items()}
        norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
        no = lambda ws: sum(w in NEGATIONS for w in ws)
        v = vec(ws)
        scores = [(-round(sum(v.get(w, 0) * x for w, x in vec(words(t)).items()) / norm(v) / norm(vec(words(t))), 9), name) for name, t in templates if len(ws) > 60 or no(ws) <= no(words(t))] if ws else []
        return min((s for s in scores if -s[0] >= least), default=None)

    assert vocab
    out = []
    for i, path, t in files:
        ws = words(t or "")
        whole = [best(TEXTS, ws, text_threshold)] + [best(OPENINGS, ws[: len(words(o))], text_threshold) for _, o in OPENINGS if len(ws) >= 3 * len(words(o))]
        whole = min(filter(None, whole), default=None)
        taken, found, share, total = set(), [], 0, 0
        for at, unit in line_units(t or ""):
            size = sum(len(w.encode()) for w in words(unit))
            total += size * (len(at) == 1)
            if not taken & at and (m := best(TEMPLATES, words(unit), threshold)):
                taken |= at
                found.append(m)
                share += size
        head = words(header_of((t or "").encode()).decode())
        header = best((*HEADERS, *TEXTS), head, threshold)
        if header:
            share = max(share, sum(len(w.encode()) for w in head))
        one = whole or min([*found, *filter(None, [header])], default=None)
        out.append([i, path, len(found), one, bool(whole) or bool(one) and share / total >= file_share])
    result = []
    for i, path, n, one, stands in out:
        if one:
            result.append((i, n, one[1], round(-one[0], 6), "file" if stands else "header", None))
            continue
        got = None
        up = path.rpartition("/")[0].split("/") if path and "/" in path else [] if path is not None else None
        while up is not None and got is None:
            here = [(b, p) for _, p, _, b, w in out if w and p is not None and (p.rpartition("/")[0].split("/") if "/" in p else []) == up]
            if here:
                (s, name), p = min(here, key=lambda x: (x[0][0], x[1]))
                got = (i, 0, name, round(-s, 6), "inherited", p)
            up = up[:-1] if up else None
        result.append(got or (i, 0, None, None, None, None))
    return sorted(result, key=str)


def found(spark, files):
    df = spark.createDataFrame([(*f, "x", 1.0) for f in files], "file_id bigint, path string, text string, license string, score double")
    return sorted(((r.file_id, len(r.notices), r.license, None if r.score is None else round(r.score, 6), r.how, r.from_path) for r in scan_licenses(df).collect()), key=str)


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width))


def commented(text):
    return "/*\n" + "".join(f" * {line}\n" for line in ["Copyright 2020 Some Body", *textwrap.wrap(text, 70)]) + " */\n"


def test_whole_headers_and_licence_files(spark):
    texts, headers = dict(TEXTS), dict(HEADERS)
    two_lines = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n"
    files = [(i, f"{n}/LICENSE", f"{n} License\n\nCopyright (c) 2019, The Authors\n\n{wrapped(t, 72)}\n") for i, (n, t) in enumerate(texts.items())]
    files += [(10 + i, f"{n}/src/deep/main.c", "int main() { return 0; }") for i, n in enumerate(texts)]
    files += [(20 + i, f"h{i}/x.c", commented(t) + "int y;\n" * 300) for i, t in enumerate(headers.values())]
    files += [(30, "bsd/x", "int a;\n" * 50 + "\n" + two_lines), (31, "no/x", "Not released under the MIT License."), (32, "no/y", "The MIT License is often named in talks about software."), (33, "apache/LICENSE", wrapped(OPENINGS[0][1], 72) + "\n" + "more terms of it follow here. " * 200), (34, "apache/a/b", "x")]
    got = {r[0]: r[2:] for r in found(spark, files)}
    assert all(got[i][0] == n and got[i][2] == "file" for i, n in enumerate(texts))
    assert all(got[10 + i][0] == n and got[10 + i][2:] == ("inherited", f"{n}/LICENSE") for i, n in enumerate(texts))
    assert all(got[20 + i][0] == n and got[20 + i][2] == "header" for i, n in enumerate(headers))
    assert got[30][0] == "BSD-3-Clause" and got[30][2] == "header"
    assert got[31] == got[32] == (None, None, None, None)
    assert got[33][0] == "Apache-2.0" and got[34][2:] == ("inherited", "apache/LICENSE")


def test_equals_brute_force(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("alpha beta the under license of this word public version 2 3".split()) for _ in range(n))
    files = [(i, f"{rng.choice('ab')}/{rng.choice('cd')}/{rng.choice(['', 'e/'])}f{i}", say(30) + "\n" + rng.choice([say(5), rng.choice(TEMPLATES)[1], "Licensed under CC BY-NC 4.0."]) + "\n" + say(9)) for i in range(60)]
    files += [(100, "a/LICENSE", "Released under the MIT License."), (101, "b/d/COPYING", TEMPLATES[3][1]), (102, "b/d/e/N", TEMPLATES[7][1] + "\nword"), (103, "top", "x")]
    files += [(104, None, "no path"), (105, "a/z/q/w/r", None), (106, "a/z", ""), (106, "a/z", ""), (107, None, TEMPLATES[0][1]), (108, "q/r", "Released under the MIT License. " * 3), (109, "q/s/t", "word " * 50_000)]
    files += [(110, "m/LICENSE", "The MIT License\n\nCopyright (c) 2020 A. Person\n\n" + wrapped(TEXTS[0][1], 70)), (111, "m/a.c", commented(HEADERS[0][1]) + "int x;\n" * 90), (112, "m/b", "Not released under the MIT License.")]
    files += [(113, "g/COPYING", wrapped(OPENINGS[1][1], 70) + "\n" + say(300)), (114, "g/x/y", "word"), (115, "g/n", "first line\n" + wrapped(TEMPLATES[13][1], 60) + "\nmore")]
    assert found(spark, files) == plain(files)


def test_root_licence_and_empty_table(spark):
    files = [(1, "LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "x/y/z", "abc"), (3, "w", "abc")]
    assert [r[2:] for r in found(spark, files)][1:] == [("Apache-2.0", found(spark, files)[0][3], "inherited", "LICENSE")] * 2
    assert found(spark, []) == []
