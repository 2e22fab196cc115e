"""Toxicity scores by a counterfactual-regularised classifier over the words of whole texts.

Fitting takes a bounded sample of labelled documents. Words, and beginnings of words, whose presence goes with the label
beyond chance are kept, and a ridge logistic regression is fitted on them by Newton's method. Each sentence of a labelled
document that names identity groups is rewritten with the terms swapped for others of the same kind; the
squared difference of the document's two scores (before the sigmoid) is part of the loss. A group name that happens
to be frequent in toxic sentences so gets no score of its own, and neutral mentions stay low.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.arrow import byte_values, release_memory
from sparkloom.llm.decontaminate import words_of

#: Identity terms by kind, in English, German, French and Spanish; terms of one kind are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer"),
    ("frau", "mann"),
    ("mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch"),
    ("schwarze", "weiße", "asiaten", "araber", "türken"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ("femmes", "hommes"),
    ("femme", "homme"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("musulman", "chrétien", "juif", "hindou", "bouddhiste", "athée"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("gays", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "aveugles", "sourds", "âgés", "jeunes"),
    ("mujeres", "hombres"),
    ("mujer", "hombre"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("musulmán", "cristiano", "judío", "hindú", "budista", "ateo"),
    ("negros", "blancos", "asiáticos", "árabes", "latinos"),
    ("gais", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("discapacitados", "ciegos", "sordos", "ancianos", "jóvenes"),
)
SENTENCE = re.compile(rb"[.!?\n]+")
KEPT = 1 << 18  # words whose weight a task remembers


def word_key(word: bytes) -> int:
    """A feature: 63 bits of the word's hash."""
    return xxhash.xxh3_64_intdigest(word) >> 1


def features_of(word: bytes) -> list[int]:
    """The word, and for longer ones its first four and five bytes: inflected forms share them."""
    own = [word_key(word)]
    return own + [word_key(b"\1" + word[:4]), word_key(b"\1" + word[:5])] if len(word) > 5 else own


def feature_array(words: set[bytes]) -> np.ndarray:
    return np.array(sorted({k for w in words for k in features_of(w)}), np.int64)


def swapped_terms(kinds=IDENTITY_TERMS) -> dict[bytes, list[bytes]]:
    """The terms that each term is swapped for; one that is in several kinds is swapped within all of them."""
    out: dict[bytes, list[bytes]] = {}
    for kind in kinds:
        for t in kind:
            own = out.setdefault(t.encode(), [])
            own += [x.encode() for x in kind if x != t and x.encode() not in own]
    return out


def rewritten(text: bytes, swaps: dict[bytes, list[bytes]]) -> dict[tuple[bytes, bytes], int]:
    """What changes in a text's features where one of its sentences has its identity terms swapped: ``(features gone,
    features new)``, packed, and how many rewritten sentences change it so. A sentence gives as many forms as its terms have swaps at most."""
    sentences = [set(words_of(s)) for s in SENTENCE.split(text)]
    forms: dict[tuple[bytes, bytes], int] = {}
    if all(map(swaps.keys().isdisjoint, sentences)):
        return forms
    held = Counter(w for s in sentences for w in s)
    features = Counter(k for w in held for k in set(features_of(w)))
    for sentence in sentences:
        there = sorted(sentence & swaps.keys())
        for turn in range(max((len(swaps[w]) for w in there), default=0)):
            after = {swaps[w][turn % len(swaps[w])] for w in there}
            lost = Counter(k for w in there if held[w] == 1 and w not in after for k in set(features_of(w)))
            new = {k for w in after if w not in held for k in features_of(w)}
            gone = {k for k, n in lost.items() if features[k] == n} - new
            change = (np.array(sorted(gone), np.int64).tobytes(), np.array(sorted(new - features.keys()), np.int64).tobytes())
            forms[change] = forms.get(change, 0) + 1
    return forms


@dataclass(frozen=True)
class ToxicityModel:
    """``bias`` and weights by feature; the score of a text is the sigmoid of bias plus the weights of its features, each once."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def score(self, words: list[bytes], known: dict[bytes, tuple[int, ...]] | None = None) -> float:
        """``known`` remembers which features of a word have weights, from one text to the next."""
        known = {} if known is None else known
        active: set[int] = set()
        for w in set(words):
            keys = known.get(w)
            if keys is None:
                keys = tuple(k for k in features_of(w) if k in self.weights)
                if len(known) >= KEPT:
                    known.clear()
                known[w] = keys
            if keys:
                active.update(keys)
        x = self.bias + sum(self.weights[k] for k in sorted(active))
        return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def in_fold(id_col: Column, folds: int = 5) -> Column:
    """Whether the row is held out: CRC-32 of the id as text, modulo ``folds``, is 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


Row = tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]


def labelled_features(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, kinds) -> list[Row]:
    """``(label, features, forms)`` of the sampled rows, at most ``max_rows``; a form is ``(features gone, features new, how often)``."""
    order = F.xxhash64(F.col("id").cast("string"), F.col("label"))
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~in_fold(F.col("id")))
    sample = marked.orderBy(order, "id", "label").limit(max_rows)  # bounded, so it may be broadcast
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "label", "text")
    swaps = swapped_terms(kinds)
    form = pa.list_(pa.struct([("gone", pa.binary()), ("new", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_values(batch.column(2))
            own = [feature_array(set(words_of(t))).tobytes() for t in texts]
            forms = [[{"gone": a, "new": b, "n": n} for (a, b), n in rewritten(t, swaps).items()] for t in texts]
            columns = [batch.column(0).cast(pa.string()), batch.column(1), pa.array(own, pa.binary()), pa.array(forms, form)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "words", "forms"])

    found = joined.mapInArrow(run, "id string, label int, words binary, forms array<struct<gone:binary,new:binary,n:bigint>>")
    # rows repeated in docs do not lift the bound
    rows = found.orderBy(F.xxhash64("id", "words"), "id", "label").limit(max_rows).select("label", "words", "forms").collect()
    keys = lambda x: np.frombuffer(x, np.int64)
    return [(r.label, keys(r.words), [(keys(f["gone"]), keys(f["new"]), f["n"]) for f in r.forms]) for r in rows]


def fit_model(
    rows: list[Row], ridge: float = 1.0, fairness: float = 1.0, least_z: float = 4.0, max_features: int = 1000, kinds=IDENTITY_TERMS
) -> ToxicityModel:
    """Fit the classifier; ``fairness`` weighs the squared score changes of rewritten forms, 0 leaves them out.

    Kept are words with a z value of ``least_z`` or more, and identity terms; at most ``max_features``.
    Without rows of both labels every text scores the share of label 1, or 0.5 without any row.
    """
    n = len(rows)
    y = np.array([r[0] for r in rows], float)
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return ToxicityModel(float(np.log(share / (1 - share))))
    p = y.mean()
    keys, where = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
    of = np.repeat(np.arange(n), [len(r[1]) for r in rows])
    df = np.bincount(where, minlength=len(keys))
    gain = np.bincount(where, weights=(y - p)[of], minlength=len(keys))
    z = np.abs(gain) / np.sqrt(np.maximum(df * (1 - df / n), 0.5) * p * (1 - p))
    z[df < 3] = 0
    identity = np.isin(keys, [word_key(t) for t in swapped_terms(kinds)])
    rank = np.where(identity, np.inf, z)
    chosen = np.argsort(-rank, kind="stable")[:max_features]
    chosen = np.sort(chosen[rank[chosen] >= least_z])
    kept = keys[chosen]
    at = {int(k): i for i, k in enumerate(kept)}
    k = len(kept)

    x = np.zeros((n, k + 1), np.float32)
    x[:, k] = 1
    slot = np.full(len(keys), -1)
    slot[chosen] = np.arange(k)
    there = slot[where] >= 0
    x[of[there], slot[where[there]]] = 1
    change = np.zeros((k + 1, k + 1))
    for _, _, forms in rows:
        for gone, new, many in forms:
            d = np.zeros(k + 1)
            d[[at[f] for f in gone.tolist() if f in at]] = 1
            d[[at[f] for f in new.tolist() if f in at]] = -1
            change += np.outer(d, d) * many / sum(f[2] for f in forms)
    penalty = ridge * np.eye(k + 1)
    penalty[k, k] = 1e-6
    penalty += 2 * fairness * change
    w = np.zeros(k + 1)
    w[k] = np.log(p / (1 - p))
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + w @ penalty @ w / 2)
    now = loss(w)
    for _ in range(50):
        s = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (s - y) + penalty @ w
        h = (x * (s * (1 - s))[:, None]).T @ x + penalty
        step, size = np.linalg.solve(h, g), 1.0
        while (new := loss(w - size * step)) > now and size > 1e-6:
            size /= 2
        w, gained, now = w - size * step, now - new, new
        if gained < 1e-9 * max(1.0, abs(now)):
            break
    return ToxicityModel(float(w[k]), {int(key): float(v) for key, v in zip(kept, w[:k]) if v})


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 5_000, kinds=IDENTITY_TERMS, **fit) -> ToxicityModel:
    """Fit on at most ``max_rows`` labelled rows outside the held-out fold, taken by hash of the id.

    Null labels and labels other than 0 and 1, null ids and labels without a document are left out. A
    document labelled twice counts twice.
    """
    return fit_model(labelled_features(docs, labels, id_col, text_col, label_col, max_rows, kinds), kinds=kinds, **fit)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text, 0 to 1; null and empty texts score as having no words.

    All rows and all other columns stay; a column already named like the new one is replaced.
    """
    kept = [f for f in docs.schema if f.name != score_col]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in batches:
            texts = byte_values(batch.column(batch.schema.get_field_index(text_col)))
            scores = [model.score(words_of(t), known) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score_col])
        del known
        release_memory()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{score_col}` double"])
    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def counterfactual_gap(model: ToxicityModel, texts: list[str], kinds=IDENTITY_TERMS) -> float:
    """Mean absolute score change over the rewritten forms of ``texts``; 0 if none names a group."""
    swaps, gaps = swapped_terms(kinds), []
    for text in texts:
        words = words_of(text.encode())
        for i, w in enumerate(words):
            for other in swaps.get(w, ()):
                gaps.append(abs(model.score(words) - model.score([*words[:i], other, *words[i + 1 :]])))
    return float(np.mean(gaps)) if gaps else 0.0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_toxicity(docs, model, score_col="score")
    return scored.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
