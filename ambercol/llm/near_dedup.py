"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document is its set of word shingles. A sketch has ``BINS`` coordinates, filled in rounds: in each round every shingle is hashed
into one bin with a value that later rounds never undercut, and after as many rounds as there are bins each further round throws
all shingles into one bin; so every coordinate fills, and the share of equal coordinates of two sketches is concentrated around
the sets' Jaccard similarity as if all coordinates were independent. ``BANDS`` keys of ``ROWS`` of them propose candidates: at a
similarity of 0.8 a pair shares no key with probability 5e-8. Sets that are equal are one node from the start.

What a bucket proposes is verified on whole sets, and no bucket's pairs are enumerated. Each member is compared with the bucket's
leader, the one that meets the most others. In buckets whose members are then in different components the remaining pairs are
found by an exact prefix join over differences from the leader: for sets u, v and any reference b the symmetric differences
D(u) = u ^ b and D(v) = v ^ b satisfy D(u) ^ D(v) = u ^ v, so a similar pair must share a number of elements of D that follows from
sizes alone, and one of them is among the rarest few of either. Near copies differ from their leader in few elements, most of
them their own, which meet nothing. Work grows with the members, not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, bounded, lean, texts_of, to_batch, unused, written
from .components import components

BINS, BANDS, ROWS = 128, 32, 4
#: Members that one task compares with a leader.
BLOCK = 4096

_M1, _M2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def words(text: str) -> list[bytes]:
    """Words of a text between white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingles(text: str, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of a shorter text's whole word sequence; none without words."""
    own = words(text)
    n = len(own)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=1)] if n else [], np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, n)
    s = h[: n - k + 1].copy()
    for j in range(1, k):
        s = _mix(s) + h[j : n - k + 1 + j]
    return np.unique(_mix(s))


_SEEDS = _mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_KEEP = np.uint64((1 << 48) - 1)
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def sketch(s: np.ndarray) -> np.ndarray:
    """The coordinates of a non-empty set: (round, hash) of the least value thrown into each bin."""
    out = np.full(BINS, ~np.uint64(0))
    step = max(1, 512 // len(s))
    for r in range(0, BINS, step):
        rounds = np.arange(r, min(r + step, BINS), dtype=np.uint64)
        x = _mix(s[None, :] ^ _SEEDS[rounds.astype(np.intp)][:, None])
        np.minimum.at(out, (x >> _SHIFT).ravel().astype(np.intp), ((rounds[:, None] << np.uint64(48)) | (x & _KEEP)).ravel())
        if out.max() != ~np.uint64(0):
            return out
    for b in np.flatnonzero(out == ~np.uint64(0)):
        r = BINS + int(b)
        out[b] = np.uint64(r << 48) | (_mix(s ^ _SEEDS[r]) & _KEEP).min()
    return out


def keys_of(coordinates: np.ndarray) -> np.ndarray:
    """A key for each band."""
    c = coordinates[: BANDS * ROWS].reshape(BANDS, ROWS)
    acc = _mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_M2))
    for j in range(ROWS):
        acc = _mix(acc ^ c[:, j]) + np.uint64(j)
    return acc.view(np.int64)


def _signatures(k: int):
    schema = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("set_hash", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for at in range(0, len(ids), 512):
                rows = []
                for i, h, text in zip(ids[at : at + 512], hashes[at : at + 512], texts_of(batch.slice(at, 512), 1)):
                    s = shingles(text, k)
                    rows.append((i, h, len(s), xxhash.xxh3_128_digest(s.tobytes()), keys_of(sketch(s))) if len(s) else (i, h, 0, None, None))
                yield to_batch(rows, schema)

    return run


def _compared(pairs: DataFrame, rows: DataFrame, k: int, percent: int, differences: bool = False) -> DataFrame:
    """Each pair (a, leader b; m, about how many a leader has): a, part, b, na, nb, linked, on whole sets.

    A leader's members are dealt out by ``BLOCK`` and stream past it. ``part`` tells several texts of one id apart; of a leader's
    several texts that of most shingles is the reference, and a link with any counts. With ``differences`` also (space, d, tokens): the elements in which a differs from
    b (space 1) for sets of no less than 0.64 of b's size, and a's own elements (space 0) for those under 0.8 of it. Two
    similar sets have a space in common, and neither space has more elements than about 2.6 times the set.
    """
    dealt = written(pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / BLOCK)).cast("int")).select("a", "b", "salt"), "pairs")
    wanted = dealt.select(F.col("a").alias("id")).unionByName(dealt.select(F.col("b").alias("id"))).distinct()
    texts = rows.join(bounded(wanted, "wanted"), "id", "left_semi")
    leads = dealt.select(F.col("b").alias("id"), "b", "salt").distinct().withColumn("member", F.lit(False))
    placed = dealt.select(F.col("a").alias("id"), "b", "salt", F.lit(True).alias("member")).unionByName(leads)
    placed = placed.join(texts, "id").select("b", "salt", "member", "id", "text")
    fields = [("a", pa.int64()), ("part", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64()), ("linked", pa.bool_())]
    kinds = "a long, part long, b long, na long, nb long, linked boolean"
    if differences:
        fields += [("space", pa.int32()), ("d", pa.int64()), ("tokens", pa.list_(pa.int64()))]
        kinds += ", space int, d long, tokens array<long>"
    schema, less, more = pa.schema(fields), 100 - percent, 100 + percent

    def run(batches):
        group, leads, seen = None, [], (None, set())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for b, salt, member, i, text in zip(*(part.column(c).to_pylist() for c in range(4)), texts_of(part, 4)):
                    s = shingles(text, k)
                    if (b, salt) != group:
                        group, leads = (b, salt), []
                    if not member:
                        leads = sorted([*leads, s], key=lambda x: (len(x), x.tobytes()))
                        continue
                    own = xxhash.xxh3_64_intdigest(s.tobytes()) >> 1
                    if (b, salt, i) != seen[0]:
                        seen = (b, salt, i), set()
                    if own in seen[1]:
                        continue
                    seen[1].add(own)
                    lead, na = leads[-1], len(s)
                    apart = [na + len(x) - 2 * len(np.intersect1d(s, x, assume_unique=True)) for x in leads]
                    linked = any(more * d <= less * (na + len(x)) for d, x in zip(apart, leads))
                    row = (i, own, b, na, len(lead), linked)
                    if not differences:
                        out.append(row)
                        continue
                    if 10_000 * na >= percent * percent * len(lead):
                        out.append((*row, 1, apart[-1], np.setxor1d(s, lead, assume_unique=True).view(np.int64)))
                    if 100 * na < percent * len(lead):
                        out.append((*row, 0, na, s.view(np.int64)))
                if out:
                    yield to_batch(out, schema)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = placed.repartition(tasks, "b", "salt").sortWithinPartitions("b", "salt", "member", "id")
    return written(streams.mapInArrow(lean(run), kinds), "compared")


def _across(found: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one leader's buckets that are in different components, from their differences."""
    less, more = 100 - percent, 100 + percent
    own = ["b", "space", "a", "part"]
    each = found.select(*own, F.explode("tokens").alias("token"))
    shared = each.groupBy("b", "space", "token").agg(F.count("*").alias("df")).filter("df > 1")
    # what only one member has meets nothing; the rest from the rarest on, after those
    ordered = each.join(shared, ["b", "space", "token"]).groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("s"))
    # the least number of elements that a similar pair has in common: with a member that is not linked to the leader (half),
    # whose difference is more than the bound with the leader, and with one that is (full); ceil(x / 2 more), 1 at least
    up = lambda x: F.greatest(F.ceil(x / (2 * more)), F.lit(1))
    half = F.when(F.col("space") == 0, F.ceil(F.col("na") * percent / 100)).otherwise(up(more * F.col("d") - less * F.col("na") + less * F.col("nb") + 1))
    full = F.when(F.col("space") == 0, half).otherwise(up(more * F.col("d") - less * (F.col("na") + F.col("nb")) + more - less))
    facts = found.join(labels, found.a == labels.id, "left").select(*own, "na", "d", ((F.col("space") == 1) & (more * F.col("d") <= less * (F.col("na") + F.col("nb")))).alias("near"), F.coalesce("component", "a").alias("c"), half.alias("half"), full.alias("full"))
    at = F.col("d") - F.size("s") + F.col("i")
    keyed = ordered.join(facts, own).select("*", F.posexplode("s").alias("i", "x")).withColumn("at", at)
    keyed = keyed.filter(F.col("at") <= F.col("d") - F.when(F.col("near"), F.col("half")).otherwise(F.least("half", "full")))
    keyed = written(keyed.select(*own, F.col("x.token").alias("token"), "na", "d", "near", "c", (F.col("at") <= F.col("d") - F.col("half")).alias("early"), "at"), "prefixes")
    one, two = keyed.filter("not near").alias("u"), keyed.filter("early").alias("v")
    u, v = lambda c: F.col(f"u.{c}"), lambda c: F.col(f"v.{c}")
    needed = more * (u("d") + v("d")) - less * (u("na") + v("na"))
    same = (u("b") == v("b")) & (u("space") == v("space")) & (u("token") == v("token")) & (u("c") != v("c"))
    sizes = 100 * F.least(u("na"), v("na")) >= percent * F.greatest(u("na"), v("na"))
    # at the first element that a pair has in common enough others follow in either
    rest = 2 * more * F.least(u("d") - u("at"), v("d") - v("at")) >= needed
    met = one.join(two, same & sizes & rest & (v("near") | u("early") & (u("a") < v("a"))))
    met = written(met.select(u("b").alias("b"), u("space").alias("space"), u("a").alias("a"), u("part").alias("p"), v("a").alias("a2"), v("part").alias("p2")).distinct(), "met")
    side = lambda x: found.select("b", "space", F.col("a").alias(f"a{x}"), F.col("part").alias(f"p{x}"), F.col("na").alias(f"n{x}"), F.col("d").alias(f"d{x}"), F.col("tokens").alias(f"t{x}"))
    both = met.join(side(""), ["b", "space", "a", "p"]).join(side("2"), ["b", "space", "a2", "p2"])
    enough = 2 * more * F.size(F.array_intersect("t", "t2")) >= more * (F.col("d") + F.col("d2")) - less * (F.col("n") + F.col("n2"))
    return written(both.filter(enough).select("a", F.col("a2").alias("b")).distinct(), "links")


def labelled(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, n and component of each row; see ``near_duplicates``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = rows.withColumn("hash", F.xxhash64("text")).mapInArrow(lean(_signatures(k)), "id long, text_hash long, n long, set_hash binary, keys array<long>")
    signed = written(signed, "signatures")
    # equal sets have equal keys; counting them together first leaves no hot set
    nodes = written(signed.filter("n > 0 and id is not null").groupBy("set_hash").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("keys").alias("keys")), "nodes")
    bands = nodes.select("id", "n", F.explode("keys").alias("key"))
    members = written(bands.join(bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "key"), "members")
    # the original of many near copies meets more of them than they meet each other
    meets = members.groupBy("id").agg(F.sum("m").alias("meets"))
    leaders = members.join(meets, "id").groupBy("key").agg(F.max(F.struct("meets", F.bitwise_not("id").alias("i"), "n")).alias("most"))
    leaders = leaders.select("key", F.bitwise_not("most.i").alias("b"), F.col("most.n").alias("nb"))
    stars = written(members.join(leaders, "key").filter("id != b").select("key", F.col("id").alias("a"), "n", "b", "nb", "m"), "stars")
    sized = stars.filter(100 * F.least("n", "nb") >= percent * F.greatest("n", "nb")).groupBy("a", "b").agg(F.max("m").alias("m"))
    links = _compared(sized, rows, k, percent).filter("linked").select("a", "b")
    labels = components(links)
    # a bucket of two had its one pair compared; of larger ones those whose members are in different components are looked at again
    of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    open_keys = stars.filter("m > 2").join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("key").distinct()
    again = stars.join(open_keys, "key", "left_semi").groupBy("a", "b").agg(F.max("m").alias("m"))
    more = _across(_compared(again, rows, k, percent, True), labels, percent)
    if not more.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    out = signed.select("id", "text_hash", "n", "set_hash").join(nodes.select("set_hash", F.col("id").alias("node")), "set_hash", "left").join(labels.withColumnRenamed("id", "node"), "node", "left")
    return out.select("id", "text_hash", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id")).alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id (least doc_id linked to it, through others too; itself included).

    Documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles, for ``percent`` of 80 or more
    (the banding is laid out for that). A text of fewer than k words is one shingle; a null or empty one, or one without words,
    has none and is linked with nothing. Rows that repeat an id are one document with several texts. A null id gives a row that
    is linked with nothing. An empty table gives no rows. Other columns are not read.
    """
    return labelled(docs, k, percent, id_col, text_col).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, that of the least id, all columns as they are.

    Rows with a null id or without words are linked with nothing, and all stay. Of rows that repeat an id and a text one stays; a
    repeated id with another text is judged by that text, and stays if nothing of a lesser id is linked to it.
    """
    i, h = unused(docs, "id", "hash")
    found = written(labelled(docs, k, percent, id_col, text_col).filter("id is not null"), "found")
    key = lambda df: df.select(F.col("id").alias(i), F.col("text_hash").alias(h))
    same = (docs[id_col].cast("long") == F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(h))
    out = docs.join(bounded(key(found.filter("component != id")).distinct(), "dropped"), same, "left_anti")
    repeated = found.filter("component = id and n > 0").groupBy("id", "text_hash").count().filter("count > 1")
    if repeated.isEmpty():
        return out
    repeated = bounded(key(repeated), "repeated")
    return out.join(repeated, same, "left_anti").unionByName(docs.join(repeated, same, "left_semi").dropDuplicates([id_col, text_col]))


def near_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, for each row: four-word shingles; ``kept`` is NULL where the id is."""
    return near_duplicates(docs, k=4).withColumn("kept", F.col("doc_id") == F.col("component_id"))
