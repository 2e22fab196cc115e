import hashlib

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import content

SCHEMA = "k int, v double, q array<double>, b binary, note string"


def rows(n=200):
    return [(i, i / 3 if i % 9 else None, [0.1 * i, 0.0, 1.0, 0.5 - i % 2], bytes([i % 256]), None) for i in range(n)]


def test_equal_content_has_equal_digests(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    digest = lambda d, **kw: content.table_summary(d, ["k"], optional=("note",), quaternions=("q",), **kw).first()
    want = digest(df)
    assert want.rows == 200 and want.columns == '["k","v","q","b"]'
    moved = df.repartition(7).withColumn("v", F.col("v") + 1e-13).withColumn("q", F.transform("q", lambda x: -2 * x)).drop("note")
    assert digest(moved) == want
    for other in (df.withColumn("v", F.when(F.col("k") == 77, F.col("v") + 1e-8).otherwise(F.col("v"))), df.withColumn("note", F.when(F.col("k") == 3, "x"))):
        assert digest(other).sha256 != want.sha256
    assert digest(df.limit(0)).rows == 0
    fields = {r.field: r for r in content.field_digests(df, ["k"], ["v", "b"]).collect()}
    other = {r.field: r for r in content.field_digests(df.withColumn("v", F.when(F.col("k") != 8, F.col("v"))), ["k"], ["v", "b"]).collect()}
    assert fields["b"] == other["b"] and fields["v"].sha256 != other["v"].sha256 and fields["v"].rows == 200


def test_changed_rows_are_found(spark):
    old = rows() + [(None, 1.0, None, None, "x"), (500, 1.0, None, None, "twice"), (500, 1.0, None, None, "twice")]
    new = [r for r in old if r[0] != 17] + [(900, 0.0, None, None, None), (500, 1.0, None, None, "twice")]
    new = [(k, -0.0 if k == 0 else v, q, b, "new" if k == 44 else s) for k, v, q, b, s in new]
    new[0] = (0, None, *new[0][2:])
    a, b = (spark.createDataFrame(x, SCHEMA) for x in (old, new))
    got = {(r.k, r.state) for r in content.changed_rows(a, b.select("note", "b", "q", "v", "k"), ["k"]).collect()}
    assert got == {(17, "removed"), (900, "added"), (44, "changed"), (500, "changed")}
    assert content.changed_rows(a, a.repartition(3), ["k"]).count() == 0 == content.changed_rows(a.limit(0), a.limit(0), ["k"]).count()
    assert content.changed_rows(a.limit(0), a, ["k"], depth=2).count() == 202
    with pytest.raises(ValueError):
        content.changed_rows(a, b.drop("note"), ["k"])


def test_tree_digests_equal_a_recursion(spark):
    nodes = {"": ("group", {"z": "1", "a": None}, None, None), "x": ("group", {}, None, None), "y": ("dataset", {"u": "m"}, b"123", "gzip")}
    nodes |= {f"x/{i:03}": ("dataset", {}, bytes([i]), None) for i in range(40)} | {"x/g": ("group", {}, None, None), "x/g/d": ("dataset", {}, b"", None)}

    def frame(items):
        return spark.createDataFrame([(p, k, a, bytearray(d) if d is not None else None, s) for p, (k, a, d, s) in items.items()], "path string, kind string, attrs map<string,string>, data binary, storage string")

    sized = lambda t: "-" if t is None else f"{len(t.encode())}:{t}"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def plain(path, layout, out):
        kind, attrs, data, storage = nodes[path]
        children = sorted(p for p in nodes if p and p.rpartition("/")[0] == path)
        hashes = [plain(p, layout, out) for p in children]
        n = len(hashes)
        while len(hashes) > 1:
            hashes = [sha("".join(hashes[i : i + 3])) for i in range(0, len(hashes), 3)]
        under = f"{n}:{hashes[0]}" if n else "-"
        own = [kind, path.rpartition("/")[2], "".join(sized(k) + sized(v) for k, v in sorted(attrs.items())), None if data is None else hashlib.sha256(data).hexdigest(), storage if layout else None]
        out[path] = sha("".join(map(sized, own)) + under)
        return out[path]

    for layout in (True, False):
        want = {}
        plain("", layout, want)
        assert {r.path: r.sha256 for r in content.tree_digests(frame(nodes), layout).collect()} == want
    assert content.tree_digests(frame(nodes).limit(0)).count() == 0
    with pytest.raises(ValueError, match="x/g"):
        content.tree_digests(frame({p: v for p, v in nodes.items() if p != "x/g"}))
