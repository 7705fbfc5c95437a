"""Quality classifier: document evidence, shrunk by hierarchical empirical Bayes over sites and their paths.

A logistic model, trained on labelled documents, gives each document's log odds of being good and of being toxic. Sites and paths
differ in how often their documents are either. A site's rate is its documents' mean evidence drawn toward the global rate, a
path's rate is drawn toward its site's; how strongly is estimated from how much the groups differ beyond what chance explains, so
that sparse groups get their parent's rate. A document's posterior combines its evidence with the rate of its path, from which its
own evidence is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORDS, texts_of, to_batch, written

BITS = 18
SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
HEADS = ("quality", "toxic")
DENSE = 9


class _Slots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) & ((1 << BITS) - 1)
        return h


_SLOTS = _Slots()


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the distinct words of a text; numbers on its shape."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(WORDS).split()
    distinct = set(words)
    n, size = max(1, len(words)), max(1, len(raw))
    symbols = size - len(raw.translate(None, SYMBOLS))
    upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = size - len(raw.translate(None, b"0123456789"))
    same = sum(map(bytes.__eq__, words[1:], words)) if len(words) > 1 else 0
    lines = raw.count(b"\n") + 1
    shape = (symbols / n, upper / n, digits / n, len(distinct) / n ** 0.75, same / n, raw.count(b"!") / n, np.log1p(len(words)), size / n, lines / n)
    return np.fromiter(map(_SLOTS.__getitem__, distinct), np.int64, len(distinct)), np.minimum(shape, 50.0)


class Model:
    """A head's weights: of word slots, of shape (with their mean and scale), and the intercept."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, shape: np.ndarray, mean: np.ndarray, scale: np.ndarray, bias: float, rate: float):
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[slots] = weights
        self.shape, self.mean, self.scale, self.bias, self.rate = shape, mean, scale, bias, rate

    def log_odds(self, slots: np.ndarray, shape: np.ndarray) -> float:
        return float(self.weights[slots].sum() + ((shape - self.mean) / self.scale) @ self.shape + self.bias)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], support: float = 0.01, lift: float = 6.0, ridge: float = 2e-5, least: int = 5) -> Model:
    """A logistic head.

    Words enter if they are in ``support`` of either class's documents, ``least`` of them at the fewest, and ``lift`` times rarer
    in the other.
    """
    y = np.array([r[2] for r in rows], float)
    count = np.zeros((2, 1 << BITS))
    for slots, _, label in rows:
        count[label, slots] += 1
    share = count / np.maximum(1, np.array([[np.sum(y == 0)], [np.sum(y == 1)]]))
    used = np.flatnonzero((share.max(0) >= support) & (count.max(0) >= least) & (share.max(0) >= lift * (share.min(0) + 1e-3)))
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    shapes = np.array([r[1] for r in rows])
    mean, scale = shapes.mean(0), shapes.std(0) + 1e-6
    x = np.zeros((len(rows), len(used) + DENSE + 1))
    for k, (slots, _, _) in enumerate(rows):
        at = place[slots]
        x[k, at[at >= 0]] = 1
    x[:, len(used) : -1] = (shapes - mean) / scale
    x[:, -1] = 1
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * len(y))
    penalty[-1] = 1e-9
    for _ in range(40):  # Newton's method; the number of words is bounded by their support
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Model(used, w[: len(used)], w[len(used) : -1], mean, scale, float(w[-1]), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)))


def _feature_rows(batches):
    schema = pa.schema([("slots", pa.list_(pa.int32())), ("shape", pa.list_(pa.float64())), *((h, pa.int32()) for h in HEADS)])
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [(s.astype(np.int32), d, q, t) for (s, d), q, t in zip(map(features, texts_of(part, 0)), part.column(1).to_pylist(), part.column(2).to_pylist())]
            yield to_batch(rows, schema)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> dict[str, Model]:
    """Both heads from at most ``most_rows`` labelled documents, those whose ids hash lowest; their features reach the driver.

    Labels of documents that are absent, null labels and labels without a class do not count. Of rows that repeat a labelled id one
    text is taken, that of the least hash. Without labelled documents of both classes a head is constant.
    """
    picked = labels.filter(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).dropDuplicates([id_col])
    wanted = picked.join(docs.select(id_col).distinct(), id_col, "left_semi").orderBy(F.xxhash64(id_col), id_col).limit(most_rows)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text")).join(F.broadcast(wanted.select(id_col, *HEADS)), id_col)
    rows = rows.groupBy(id_col, *HEADS).agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text")).select("text", *HEADS)
    got = rows.mapInArrow(_feature_rows, "slots array<int>, shape array<double>, quality int, toxic int").collect()
    out = {}
    for head in HEADS:
        data = [(np.array(r.slots, np.int64), np.array(r.shape), int(r[head] > 0)) for r in got]
        if len({d[2] for d in data}) < 2:
            rate = 0.999 if head == "quality" else 0.001
            out[head] = Model(np.array([], int), np.array([]), np.zeros(DENSE), np.zeros(DENSE), np.ones(DENSE), float(np.log(rate / (1 - rate))), rate)
        else:
            out[head] = fit(data)
    return out


def evidence(docs: DataFrame, models: dict[str, Model], id_col: str, text_col: str, site_col: str, path_col: str) -> DataFrame:
    """doc_id, site, path and each head's log odds, for each row.

    A null or empty text is judged by its shape, that of no words. Null sites and paths are '', others follow a '=', so that an
    empty name is another one. An empty table gives no rows.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), named(site_col).alias("site"), named(path_col).alias("path"), F.col(text_col).alias("text"))

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("site", pa.string()), ("path", pa.string()), *((h, pa.float64()) for h in HEADS)])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [features(t) for t in texts_of(part, 3)]
                odds = [pa.array([models[h].log_odds(*g) for g in got]) for h in HEADS]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *odds], schema=schema)

    return rows.mapInArrow(run, "doc_id long, site string, path string, quality double, toxic double")


def _strength(groups: DataFrame, rate: str, parent: Column) -> float:
    """The prior strength, in documents, of groups by the method of moments: between-group variance beyond chance."""
    p, n = F.col(f"s_{rate}") / F.col("n"), F.col("n")
    spread = F.sum(n * F.pow(p - parent, 2))
    chance = F.sum(parent * (1 - parent))
    row = groups.agg(F.sum(n), spread, chance, F.sum(n * parent * (1 - parent)), F.count("*")).first()
    total, between, by_chance, variance, count = row
    if not total or count < 2:
        return 100.0
    excess = max(between - by_chance, 0.0) / total
    return float(np.clip(variance / total / excess - 1 if excess > 0 else 1e4, 1.0, 1e4))


def classify(docs: DataFrame, labels: DataFrame, most_rows: int = 8000, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", models: dict[str, Model] | None = None) -> DataFrame:
    """doc_id, quality and toxicity (posterior probabilities), site_quality, path_quality, kept.

    ``kept``: good with a probability of a half or more, and toxic with less. Null sites and paths are a site and a path of their
    own. Rows that repeat an id each give a row. An empty table gives none. Other columns are not read. Groups are summed before
    they are shuffled, so a hot site is no burden.
    """
    models = models or train(docs, labels, most_rows, id_col, text_col)
    scored = written(evidence(docs, models, id_col, text_col, site_col, path_col), "evidence")
    p = {h: 1 / (1 + F.exp(-F.col(h))) for h in HEADS}
    sums = [F.count("*").alias("n"), *(F.sum(p[h]).alias(f"s_{h}") for h in HEADS)]
    paths = written(scored.groupBy("site", "path").agg(*sums), "paths")
    sites = paths.groupBy("site").agg(*(F.sum(c).alias(c) for c in ("n", "s_quality", "s_toxic")))
    whole = sites.agg(*(F.sum(c) for c in ("n", "s_quality", "s_toxic"))).first()
    if not whole[0]:
        return scored.select("doc_id", *(F.lit(0.0).alias(c) for c in ("quality", "toxicity", "site_quality", "path_quality")), F.lit(True).alias("kept"))
    tied = paths
    for i, h in enumerate(HEADS):
        rate = min(max(whole[i + 1] / whole[0], 1e-4), 1 - 1e-4)
        site_k = _strength(sites, h, F.lit(rate))
        rates = sites.select("site", ((F.col(f"s_{h}") + site_k * rate) / (F.col("n") + site_k)).alias(f"site_{h}"))
        tied = tied.join(rates, "site")
    tied = written(tied, "rates")
    path_k = {h: _strength(tied, h, F.col(f"site_{h}")) for h in HEADS}
    joined = scored.join(tied, ["site", "path"])
    post = {}
    for h in HEADS:
        # the path's rate without this document
        own = (F.col(f"s_{h}") - p[h] + path_k[h] * F.col(f"site_{h}")) / (F.col("n") - 1 + path_k[h])
        own = F.least(F.greatest(own, F.lit(1e-4)), F.lit(1 - 1e-4))
        base = models[h].rate
        post[h] = 1 / (1 + F.exp(-(F.col(h) + F.ln(own / (1 - own)) - float(np.log(base / (1 - base))))))
    out = joined.select("doc_id", post["quality"].alias("quality"), post["toxic"].alias("toxicity"), F.col("site_quality"), ((F.col("s_quality") + path_k["quality"] * F.col("site_quality")) / (F.col("n") + path_k["quality"])).alias("path_quality"))
    return out.withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxicity") < 0.5))
