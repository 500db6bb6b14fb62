"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A text is a multiset of five-word shingles; a shingle weighs its count times 1 + ln(1 / max(p, RARE)), p the share of
documents that hold it, from a count-mean-min sketch over all documents whose error falls with their number. Each text has
33 weighted samples. Texts with a band of three in common are compared by all of their samples, inside the band's bucket,
and form a family where enough agree. Inside a family all pairs that links found so far don't join are compared exactly
(weighted Jaccard similarity, as matrix products over blocks of bounded size). Classes are the components of these links.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import bound_batches, map_columns, written
from speechloom.llm.components import components
from speechloom.llm.word_hash import mix, word_ends, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: At 0.8, a pair shares a band with probability 1 - (1 - 0.8**3)**11 = 0.9996.
BANDS, ROWS = 11, 3
#: A pair of that similarity agrees in fewer samples than are asked for with at most this probability.
MISS = 1e-4
#: Shingles in fewer than this share of all documents weigh alike.
RARE = 0.001
#: Rows and counters a row of the document-frequency sketch, and the slices in which a row travels.
DEPTH, WIDTH, SLICES = 2, 1 << 20, 16
#: Texts compared with each other at once: by their samples, by their shingles; shingles a block holds about.
SKETCHES, BLOCK, BLOCK_SHINGLES = 2048, 256, 4_000_000

_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.array([pow(0x5851F42D4C957F2D, i, 1 << 64) for i in range(WORDS)], np.uint64)


def shingles(batch: list[str]) -> list[np.ndarray]:
    """The hashed shingles of each text, in order, repeats included: words in lower case between white space; a shorter
    text than a shingle is one shingle by itself; one without words has none."""
    plain = [" ".join(t.lower().split()) for t in batch]
    sizes = [t.count(" ") + 1 if t else 0 for t in plain]
    data = np.frombuffer(" ".join([t for t in plain if t] + [""]).encode("utf-8", "surrogatepass"), np.uint8)
    h = word_hashes(data, word_ends(data))[0]
    n = max(0, len(h) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for i in range(WORDS):
        whole += h[i : i + n] * _POWERS[i]
    whole = mix(whole)
    out, at = [], 0
    for size in sizes:
        if 0 < size < WORDS:
            out.append(mix(np.array([(h[at : at + size] * _POWERS[:size]).sum() + np.uint64(size)], np.uint64)))
        else:
            out.append(whole[at : at + max(0, size - WORDS + 1)])
        at += size
    return out


def bucket(h: np.ndarray, row: int) -> np.ndarray:
    """The counter of each shingle in a row of the sketch: other bits of the hash for each row."""
    return ((h >> np.uint64(44 - 20 * row)) & np.uint64(WIDTH - 1)).astype(np.int64)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The sketch (DEPTH rows), and the number of documents. Each task adds up its own; tasks' slices are added in two steps."""

    def count(batches):
        from pyspark import TaskContext

        total, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        held: list[np.ndarray] = []

        def add_held():
            h = np.concatenate([np.empty(0, np.uint64), *held])
            for row in range(DEPTH):
                total[row] += np.bincount(bucket(h, row), minlength=WIDTH)
            held.clear()

        for b in batches:
            found = [counted(h)[0] if len(h) else h for h in shingles(b["text"])]
            n += len(found)
            held += found
            if sum(map(len, held)) > WIDTH:
                add_held()
        if n:
            add_held()
            part, size = TaskContext.get().partitionId() % 64, DEPTH * WIDTH // SLICES
            slices = total.reshape(SLICES, size)
            yield {"part": [part] * SLICES, "slice": list(range(SLICES)), "n": [n] + [0] * (SLICES - 1), "counts": [x.astype(narrow(x)).tobytes() for x in slices]}

    def add(batches):
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for part, piece, n, data in zip(b["part"], b["slice"], b["n"], b["counts"], strict=True):
                x = wide(data)
                if (part, piece) in total:
                    total[part, piece][0] += n
                    total[part, piece][1] += x
                else:
                    total[part, piece] = [n, x]
        if total:
            yield {"part": [-1] * len(total), "slice": [s for _, s in total], "n": [v[0] for v in total.values()], "counts": [v[1].astype(narrow(v[1])).tobytes() for v in total.values()]}

    fields = "part int, slice int, n long, counts binary"
    own = map_columns(docs.select(F.coalesce("text", F.lit("")).alias("text")), fields, count)
    some = map_columns(own.repartition("part", "slice"), fields, add)
    rows = map_columns(some.repartition("slice"), fields, add).collect()
    sketch, n = np.zeros((SLICES, DEPTH * WIDTH // SLICES), np.int64), 0
    for r in rows:
        sketch[r.slice] += wide(r.counts)
        n += r.n
    return sketch.reshape(DEPTH, WIDTH), n


def narrow(x: np.ndarray) -> type:
    """The least type that holds the counts."""
    most = int(x.max())
    return next((t for t in (np.uint8, np.uint16, np.uint32) if most <= np.iinfo(t).max), np.int64)


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(data) * SLICES // (DEPTH * WIDTH)]).astype(np.int64)


def bucket_shares(sketch: np.ndarray, n: int) -> np.ndarray:
    """The share of documents by counter, less what the row's other shingles add to a counter on average."""
    others = (sketch.sum(1, keepdims=True) - sketch) / (WIDTH - 1)
    return ((sketch - others) / max(1, n)).astype(np.float32)


def idf(h: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """1 + ln(1 / share), the share (the least of the sketch's rows) at least RARE and at most 1."""
    share = shares[0][bucket(h, 0)]
    for row in range(1, len(shares)):
        share = np.minimum(share, shares[row][bucket(h, row)])
    return 1 - np.log(np.clip(share, np.float32(RARE), np.float32(1)))


def counted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = np.sort(h)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.diff(np.append(first, len(h)))


def samples(h: np.ndarray, log_weight: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """The k-th consistent weighted sample of each run of h (runs begin at starts), as 32 bits that name shingle and level.

    r and c are Gamma(2, 1), beta is uniform, all by hash of (shingle, k); t = floor(ln w / r + beta), ln y = r (t - beta),
    and the least ln c - ln y - r wins.
    """
    z1 = mix(h + np.uint64((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    z2 = mix(z1 ^ np.uint64(0xD1B54A32D192ED03))
    unit = np.float32(2.0**-32)
    low = np.uint64(0xFFFFFFFF)
    u1, u2 = ((z1 & low).astype(np.float32) + np.float32(0.5)) * unit, ((z1 >> np.uint64(32)).astype(np.float32) + np.float32(0.5)) * unit
    u3, u4 = ((z2 & low).astype(np.float32) + np.float32(0.5)) * unit, ((z2 >> np.uint64(48)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
    beta = ((z2 >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
    r = -np.log(u3 * u4)
    t = np.floor(log_weight / r + beta)
    cost = np.log(-np.log(np.minimum(u1 * u2, np.float32(1 - 6e-8)))) - r * (t - beta) - r
    # Floats above zero order as their bits do.
    name = mix(z1 + t.astype(np.int64).astype(np.uint64) * _M3) & low
    packed = ((cost + np.float32(1024)).astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | name
    return np.minimum.reduceat(packed, starts) & low


def signatures(batch: list[str], shares: np.ndarray) -> list[tuple[list[int], bytes] | None]:
    """The band keys and the samples (32 bits each) of each text; None without words."""
    out: list[tuple[list[int], bytes] | None] = [None] * len(batch)
    group: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not group:
            return
        h = np.concatenate([g[1] for g in group])
        log_weight = np.log(idf(h, shares) * np.concatenate([g[2] for g in group])).astype(np.float32)
        starts = np.cumsum([0] + [len(g[1]) for g in group[:-1]])
        drawn, keys = np.empty((len(group), BANDS * ROWS), np.uint32), np.empty((len(group), BANDS), np.int64)
        for band in range(BANDS):
            key = np.full(len(group), band + 1, np.uint64) * _M2
            for k in range(band * ROWS, (band + 1) * ROWS):
                sample = samples(h, log_weight, starts, k)
                drawn[:, k] = sample
                key = mix(key + sample * _M3)
            keys[:, band] = key.view(np.int64)
        for (i, _, _), row, own in zip(group, keys.tolist(), drawn, strict=True):
            out[i] = row, own.tobytes()
        group.clear()
        size = 0

    for i, h in enumerate(shingles(batch)):
        if len(h):
            distinct, n = counted(h)
            group.append((i, distinct, n))
            size += len(distinct)
            if size > 30_000:
                flush()
    flush()
    return out


def least_agreement(similarity: float, n: int = BANDS * ROWS) -> int:
    """The largest number of samples, of n, that a pair of this similarity misses with a probability of at most MISS."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if below > MISS:
            return k
    return n


def node_of(text: Column) -> Column:
    """128 bits of a strong digest stand for a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


class Union:
    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def agreeing(data: list[bytes], least: int) -> np.ndarray:
    """Which pairs agree in at least that many samples."""
    s = np.frombuffer(b"".join(data), np.uint32).reshape(len(data), -1).T
    same = np.zeros((s.shape[1], s.shape[1]), np.uint8)
    for column in s:
        same += column[:, None] == column[None, :]
    return same >= least


def packed_shingles(text_shingles: np.ndarray) -> bytes:
    """Distinct shingles (8 bytes each), then how often each stands in the text (4 bytes each)."""
    h, n = counted(text_shingles) if len(text_shingles) else (text_shingles, text_shingles)
    return h.tobytes() + n.astype(np.uint32).tobytes()


def elements(data: bytes, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: each occurrence of a shingle is an element with the shingle's weight."""
    h = np.frombuffer(data, np.uint64, len(data) // 12)
    n = np.frombuffer(data, np.uint32, len(h), 8 * len(h)).astype(np.int64)
    again = np.repeat(h, n)
    nth = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
    return mix(again + nth.astype(np.uint64) * _M1), np.repeat(idf(h, shares), n).astype(np.float64)


def similar(data: list[bytes], shares: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs have at least that weighted Jaccard similarity."""
    made = [elements(d, shares) for d in data]
    total = np.array([w.sum() for _, w in made])
    owner = np.repeat(np.arange(len(made)), [len(e) for e, _ in made])
    key, weight = np.concatenate([e for e, _ in made]), np.concatenate([w for _, w in made])
    order = np.argsort(key, kind="stable")
    key, weight, owner = key[order], weight[order], owner[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    _, column = np.unique(column[shared], return_inverse=True)
    owner, weight = owner[shared], weight[shared]
    common = np.zeros((len(made), len(made)))
    width = 8192
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + width, width)) if len(column) else []
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = np.zeros((len(made), width))
        part[owner[lo:hi], column[lo:hi] % width] = np.sqrt(weight[lo:hi])
        common += part @ part.T
    either = total[:, None] + total[None, :] - common
    return (common >= (similarity - 1e-9) * either) & (total > 0)[:, None]


def spanning(linked: np.ndarray, roots: list[int]) -> list[tuple[int, int]]:
    """Pairs that join all that linked (symmetric) joins, without those whose roots others have joined."""
    union, out, unseen = Union(), [], np.ones(len(roots), bool)
    for i in range(len(roots)):
        if unseen[i]:
            unseen[i], waiting = False, [i]
            while waiting:
                x = waiting.pop()
                near = np.flatnonzero(linked[x] & unseen)
                unseen[near] = False
                for y in near.tolist():
                    waiting.append(y)
                    if union.join(roots[x], roots[y]):
                        out.append((x, y))
    return out


def compared(members: DataFrame, compare: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """A spanning set of links (a, b) inside each (family, block); members has family, block, side, node, root, data.

    compare tells which pairs of a block are linked. Pairs of equal roots are left out, and those of equal sides other than
    -1. A block's rows come one after the other, and at most a block is held at once.
    """

    def rows(batches):
        for b in batches:
            yield from zip(b["family"], b["block"], b["side"], b["node"], b["root"], b["data"], strict=True)

    def link(batches):
        out: dict[str, list] = {"a": [], "b": []}
        for _, group in groupby(rows(batches), key=lambda r: r[:2]):
            held = list(group)
            if len(held) < 2:
                continue
            good, sides = compare([r[5] for r in held]), np.array([r[2] for r in held])
            if sides[0] >= 0:
                good &= sides[:, None] != sides[None, :]
            for i, j in spanning(good, [r[4] for r in held]):
                out["a"].append(held[i][3])
                out["b"].append(held[j][3])
            if len(out["a"]) > 4096:
                yield out
                out = {"a": [], "b": []}
        if out["a"]:
            yield out

    dealt = members.select("family", "block", "side", "node", "root", "data").repartition("family", "block").sortWithinPartitions("family", "block")
    return map_columns(dealt, "a long, b long", link)


def links_inside(members: DataFrame, compare: Callable[[list[bytes]], np.ndarray], block: int, label: str) -> DataFrame:
    """Links (a, b) with which the texts of every family are joined as if all its pairs had been compared.

    members has family, parts (blocks of the family), node, data. Families of several blocks go on: one text a root of what
    was found is compared with the family's others where they are few, and then every text outside the family's largest
    class with all of its texts, block by block, so that a group of copies that are all alike costs no more than its size.
    """
    hashed = F.pmod(F.xxhash64("node", F.lit(5)), "parts").cast("int")
    inside = members.select("family", "node", "data", hashed.alias("block"), F.lit(-1).alias("side"), F.col("node").alias("root"))
    links = written(compared(inside, compare), f"{label}-links")
    several = members.where("parts > 1")
    if not several.limit(1).count():
        return links
    several = several.withColumn("block", hashed)

    def rooted(found: DataFrame) -> DataFrame:
        return several.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))

    now = rooted(links)
    heads = now.groupBy("family", "root").agg(F.min("node").alias("node"))
    few = heads.groupBy("family").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= block)).select("family")
    chosen = heads.join(few, "family").join(several.select("family", "node", "data"), ["family", "node"])
    links = links.union(written(compared(chosen.withColumns({"block": F.lit(-1), "side": F.lit(-1)}), compare), f"{label}-heads"))
    now = written(rooted(links), f"{label}-rooted")
    sizes = now.groupBy("family", "root").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("all"))
    split = sizes.where("most.n < all").select("family", F.col("most.root").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / F.lit(block * 0.8)).cast("int").alias("minor_parts"))
    rest = now.join(split, "family")
    pair = lambda minor: minor * F.col("parts") + F.col("block")
    minor = rest.where("root <> main").withColumn("minor", F.pmod(F.xxhash64("node", F.lit(9)), "minor_parts").cast("int"))
    asking = minor.select("family", "parts", "node", "root", "data", "minor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    asked = rest.select("family", "parts", "node", "root", "data", "block", F.explode(F.sequence(F.lit(0), F.col("minor_parts") - 1)).alias("minor"))
    both = [x.select("family", pair(F.col("minor")).cast("long").alias("block"), F.lit(side).alias("side"), "node", "root", "data") for side, x in enumerate((asking, asked))]
    return links.union(written(compared(both[0].union(both[1]), compare), f"{label}-cross"))


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), class_size (rows) and class_key of every document.

    Equal texts are of one class, texts without words (null, empty, blank) only with equal ones; a null text is an empty
    one. Rows with a null doc_id take part like others; a class with no id has a null class_id. Classes are told apart by
    their texts, so where a doc_id stands with different texts, two classes can have one class_id; class_key (the least
    digest of the class) differs. An empty table gives an empty one; other columns are left out.
    """
    placed = classified(docs, similarity)
    named = placed.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min("node").alias("key"))
    return placed.join(named, "root").select("doc_id", "class_id", "class_size", F.lower(F.hex("key")).alias("class_key"))


def classified(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, node (of the text) and root (a number, the class's) of every row of docs."""
    spark = docs.sparkSession
    bound_batches(spark, 512)
    sketch, n = document_counts(docs)
    shares = spark.sparkContext.broadcast(bucket_shares(sketch, n))
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", text.alias("text"), node_of(text).alias("node"))

    def sign(batches):
        for b in batches:
            made = signatures(b["text"], shares.value)
            yield {"doc_id": b["doc_id"], "node": b["node"], "keys": [m and m[0] for m in made], "data": [m and m[1] for m in made]}

    signed = written(map_columns(plain, "doc_id long, node binary, keys array<long>, data binary", sign), "neardup-signed")
    # One row a different text, numbered for the links; then one a text and bucket, of the buckets that hold several texts.
    different = signed.groupBy("node").agg(F.first("keys").alias("keys"), F.first("data").alias("data"), F.min("doc_id").alias("doc_id"))
    different = written(different.withColumn("id", F.monotonically_increasing_id()), "neardup-texts")
    keys = different.select(F.col("id").alias("node"), F.explode("keys").alias("family"))
    sizes = keys.groupBy("family").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.when(F.col("n") <= SKETCHES, 1).otherwise(F.ceil(F.col("n") / F.lit(SKETCHES * 0.8))).cast("int").alias("parts")
    buckets = keys.join(sizes.select("family", parts), "family").join(different.select(F.col("id").alias("node"), "data"), "node")
    least = least_agreement(similarity)
    alike = links_inside(buckets, lambda data: agreeing(data, least), SKETCHES, "neardup-samples")
    families = written(components(alike).select("node", F.col("root").alias("family")), "neardup-families")

    # The text of one row a node: that of the least id, or of none where no row has one.
    named = different.select(F.col("id").alias("_id"), F.col("node").alias("_node"), F.col("doc_id").alias("_doc_id"))
    wanted = named.join(families, F.col("_id") == F.col("node")).select("_id", "_node", "_doc_id", "family")
    told = plain.join(wanted, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc_id")))

    def pack(batches):
        for b in batches:
            yield {"family": b["family"], "node": b["node"], "data": [packed_shingles(h) for h in shingles(b["text"])]}

    held = map_columns(told.select("family", F.col("_id").alias("node"), "text"), "family long, node long, data binary", pack)
    held = written(held.dropDuplicates(["node"]), "neardup-members")
    sizes = held.groupBy("family").agg(F.count("*").alias("n"), F.sum(F.length("data") / 12).alias("shingles"))
    parts = F.ceil(F.greatest(F.col("n") / F.lit(BLOCK * 0.8), F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    whole = (F.col("n") <= BLOCK) & (F.col("shingles") <= BLOCK_SHINGLES)
    members = held.join(sizes.select("family", F.when(whole, 1).otherwise(parts).alias("parts")), "family")
    links = links_inside(members, lambda data: similar(data, shares.value, similarity), BLOCK, "neardup-exact")
    roots = components(links).select(F.col("node").alias("id"), "root")
    placed = different.select("node", "id").join(roots, "id", "left").select("node", F.coalesce("root", "id").alias("root"))
    return signed.select("doc_id", "node").join(placed, "node")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, as they are, of one document of each class: that of the least doc_id (a null one comes last, and
    of equal ones that of the least digest). Of rows that repeat that id and text, one stays."""
    found = written(classified(docs, similarity), "neardup-classes")
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")
    kept = found.groupBy("root").agg(F.min(ranked).alias("first")).select(F.col("first.doc_id").alias("_doc_id"), F.col("first.node").alias("_node"))
    node, names = node_of(F.coalesce(docs["text"], F.lit(""))), docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), docs["doc_id"].alias("_id"), node.alias("_digest"))
    out = rows.join(kept, (F.col("_digest") == F.col("_node")) & F.col("_id").eqNullSafe(F.col("_doc_id")), "left_semi")
    repeated = found.groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("_doc_id"), F.col("node").alias("_node"))
    if repeated.limit(1).count():
        out = out.dropDuplicates(["_id", "_digest"])
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names])
