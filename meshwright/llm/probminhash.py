"""Near-duplicates by ProbMinHash: the shingles of a text arrive in Poisson processes whose rates are their weights, each arrival falls on a random
register, the earliest one stays, and a shingle stops once it is later than all registers. Equal registers estimate the probability Jaccard
similarity; bands of registers give candidates, and every candidate pair is verified on the whole texts.

Candidates of a bucket are not listed pair by pair. First each member is checked against the bucket's leader (the member with the most band
mates, as the original of a group of copies has); verified links are joined to components; then, in buckets that still hold several components,
pairs of different components with enough equal registers are compared whole, where they meet; only links leave a bucket, and buckets too
large for one task are first split by a second shared band, then into blocks that all meet. Pairs that share no band but that of a split bucket are
found by their signatures, of which all blocks of the bucket meet, and verified. So which pairs are compared doesn't depend on how large a bucket is.

Weights are 1 + ln(times in the text). Two texts are linked if the exact Jaccard similarity of their five-word shingles, or the exact probability
Jaccard similarity with those weights, is 0.8 or more. A text that repeats a shingle has a second sketch, in which all weights are 1, so that both
similarities have their candidates; other texts' sketches are the same by either. A pair at exactly 0.8 of one of them shares no band of that
sketch with probability 0.59 ** 24 = 3e-6.

Defined cases: equal texts are one class; a text of one to four words has one shingle of all its words; null texts and texts without a word
belong to no class but their own row's (class_id is the row's own doc_id); repeated rows and rows with one id are judged by their texts; a
class is named after its lowest doc_id, null if it has none; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from . import kernel as K
from .shared import bounded, cut, small

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Estimates below this are no candidates in the second pass: 0.8 less four and a half standard deviations of the estimate.
LEAST_EQUAL = int(REGISTERS * (LEAST - 4.5 * (LEAST * (1 - LEAST) / REGISTERS) ** 0.5))
#: Members of a bucket or block that one pass compares; larger ones are split.
BLOCK = 1024
#: Signatures of a split bucket that meet in one task, as so many blocks.
WIDE = 16
#: Hashes that different texts may share.
MOST_CLASHES = 10_000


def registers(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """The shingle that stays on each of the m registers of n texts, 0 where a text has none."""
    time, won = np.full(n * m, np.inf), np.zeros(n * m, K.U)
    x, at, step = np.zeros(len(shingle)), K.mix(shingle), 0
    width = 1
    while len(x):
        k = np.arange(step + 1, step + width + 1, dtype=K.U) * K.U(0xD6E8FEB86659FD93)
        h = K.mix(at[:, None] ^ k[None, :])
        wait = -np.log(((h >> K.U(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[:, None]
        wait[:, 0] += x
        when = np.cumsum(wait, 1)
        spot = (doc[:, None] * m + (K.mix(h) % K.U(m)).astype(np.int64)).ravel()
        flat = when.ravel()
        early = flat < time[spot]
        spot, flat, who = spot[early], flat[early], np.repeat(shingle, width)[early]
        np.minimum.at(time, spot, flat)
        hit = time[spot] == flat
        won[spot[hit]] = who[hit]
        x = when[:, -1]
        go = x < time.reshape(n, m).max(1)[doc]
        doc, shingle, weight, at, x = doc[go], shingle[go], weight[go], at[go], x[go]
        step += width
        width = width if step < 2 else min(2 * width, 64)
    return won.reshape(n, m)


def _first(text: str | Column) -> Column:
    return F.xxhash64(text)


def _second(text: str | Column) -> Column:
    return F.xxhash64(F.lit(5), text)


def _nid(avoid: list[int], text: str = "text") -> Column:
    """The number of a text: its hash, or where different texts share that (those in avoid), another one."""
    one = F.when(_first(text).isin(avoid), F.xxhash64(F.lit(7), text)).otherwise(_first(text)) if avoid else _first(text)
    return F.when(F.col(text).isNotNull(), one)


def sketch(docs: DataFrame, avoid: list[int]) -> DataFrame:
    """doc_id, nid (the text's number), nid2 (another hash) and, once for each text and task, n (its shingles), sig (a byte of each register, then
    four of each band) and bands. plain marks a further row of a text that repeats a shingle, sketched with all weights 1."""

    names = ["doc_id", "nid", "nid2", "plain", "n", "sig", "bands"]

    def sketched(ids, nid, nid2, n, won, plain):
        has = n > 0
        band = np.zeros((len(n), BANDS), K.U)
        for r in range(ROWS):
            band = K.mix(band * K.U(31) + won[:, r::ROWS])
        band = K.mix(band + np.arange(BANDS, dtype=K.U) * K.U(0x632BE59BD9B4E019)).view(np.int64)
        low = np.hstack([(K.mix(won) & K.U(255)).astype(np.uint8), (band & 0xFFFFFFFF).astype(np.uint32).view(np.uint8)])
        sig = pa.array([v.tobytes() if k else None for v, k in zip(low, has)], pa.binary())
        bands = pa.array([v if k else None for v, k in zip(band, has)], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, nid, nid2, pa.array(np.full(len(n), plain)), pa.array(n), sig, bands], names=names)

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            ids, nid, nid2 = K.column(b, "doc_id").cast(pa.int64()), K.column(b, "nid"), K.column(b, "nid2")
            new = []
            for i, x in enumerate(nid.to_pylist()):
                if x is not None and x not in seen:
                    seen.add(x)
                    new.append(i)
            mask = np.ones(len(nid), bool)
            mask[new] = False
            old = pa.array(np.flatnonzero(mask))
            if len(old):
                yield pa.RecordBatch.from_arrays([ids.take(old), nid.take(old), nid2.take(old), pa.array(np.zeros(len(old), bool)), pa.nulls(len(old), pa.int64()), pa.nulls(len(old), pa.binary()), pa.nulls(len(old), pa.list_(pa.int64()))], names=names)
            pick = pa.array(new, pa.int64())
            ids, nid, nid2 = ids.take(pick), nid.take(pick), nid2.take(pick)
            for i, a in K.pieces(K.column(b, "text").take(pick)):
                w = K.words(a)
                doc, s, times = K.shingles(w, WORDS)
                n, own = np.bincount(doc, minlength=len(a)), [x.slice(i, len(a)) for x in (ids, nid, nid2)]
                yield sketched(*own, n, registers(doc, s, 1 + np.log(times), len(a)), False)
                again = np.unique(doc[times > 1])
                if len(again):
                    of = np.isin(doc, again)
                    won = registers(np.searchsorted(again, doc[of]), s[of], np.ones(int(of.sum())), len(again))
                    yield sketched(*(x.take(pa.array(again)) for x in own), n[again], won, True)

    own = bounded(docs).select("doc_id", "text", _nid(avoid).alias("nid"), _second("text").alias("nid2"))
    return own.mapInArrow(K.tidy(run), "doc_id long, nid long, nid2 long, plain boolean, n long, sig binary, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The larger of the Jaccard and the probability Jaccard similarity of two sorted sets of shingles with weights."""
    (sa, wa), (sb, wb) = a, b
    both, i, j = np.intersect1d(sa, sb, assume_unique=True, return_indices=True)
    k = len(both)
    if not k:
        return 0.0
    plain = k / (len(sa) + len(sb) - k)
    x, y = wa[i], wb[j]
    if (x == y).all() and wa.min() == wa.max() == wb.min() == wb.max():
        return plain
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())  # weights in a of shingles whose ratio isn't lower, with those only in a
    below = np.concatenate([[0], np.cumsum(y)[:-1]]) + (wb.sum() - y.sum())
    return max(plain, float((1 / (above / x + below / y)).sum()))


def _texts(ids: DataFrame, docs: DataFrame, avoid: list[int]) -> DataFrame:
    """(nid, text) of the nids in ids, written once, so that a hot nid's side of a join can be split."""
    ids = small(cut(ids.select(F.col("nid").alias("_id")).distinct()))
    texts = docs.select(_nid(avoid).alias("nid"), "text").where("text is not null").join(ids, F.col("nid") == F.col("_id"), "left_semi")
    return cut(texts.groupBy("nid").agg(F.first("text").alias("text")))


def _sets(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's shingles, sorted, and their weights."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, a in K.pieces(column):
        doc, s, times = K.shingles(K.words(a), WORDS)
        edge, w = np.searchsorted(doc, np.arange(len(a) + 1)), 1 + np.log(times)
        out += [(s[i:j], w[i:j]) for i, j in zip(edge, edge[1:])]
    return out


def verified(pairs: DataFrame, docs: DataFrame, least: float, avoid: list[int]) -> DataFrame:
    """The pairs (u, v) of nids whose texts are similar enough, with whole texts compared."""
    pairs = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    texts = _texts(pairs.select(F.col("u").alias("nid")).union(pairs.select("v")), docs, avoid)
    a, b = texts.select(F.col("nid").alias("u"), F.col("text").alias("a")), texts.select(F.col("nid").alias("v"), F.col("text").alias("b"))

    def run(batches):
        for t in batches:
            u, v, right = K.column(t, "u"), K.column(t, "v"), K.text_array(K.column(t, "b"))
            keep = []
            for i, x in K.pieces(K.column(t, "a"), max_rows=200):
                keep += [i + k for k, (p, q) in enumerate(zip(_sets(x), _sets(right.slice(i, len(x))))) if similarity(p, q) >= least]
            pick = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([u.take(pick), v.take(pick)], names=["u", "v"])

    return cut(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(K.tidy(run), "u long, v long"))


def _linked(nid, comp, n, block, sig, marks, mask, bands, x: int, y: int, sets: list, least: float, equal: int = LEAST_EQUAL) -> list[tuple[int, int]]:
    """Links between blocks x and y of one bucket, between different components only, fewer than there are components. A pair is compared in the
    first bucket it shares: of the bands outside mask, or for split buckets in the first two inside it."""
    lab = np.unique(comp, return_inverse=True)[1]
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    ids = flat = edge = None
    # Neither similarity is above the share of either text's weight that is common: least needs own shingles <= common ones x top x slack.
    top, slack = np.array([w.max() if len(w) else 1.0 for _, w in sets]), 1 / least - 1
    out = []
    bit = 1 << np.arange(BANDS)
    for i in left.tolist():
        heavy = np.where(n[right] > n[i], top[right], top[i])  # of the text with more shingles
        j = right[(lab[right] != lab[i]) & (np.maximum(n[i], n[right]) <= np.minimum(n[i], n[right]) * (1 + heavy * slack) + 1e-9)]
        j = j[j > i] if x == y else j
        if not len(j):
            continue
        same = sig[i] == sig[j]
        ok = same.sum(1) >= equal
        j = j[ok]
        if not len(j):
            continue
        same = marks[i] == marks[j]  # of bands, as bytes of registers agree by chance too often to tell the first band shared
        split = (mask[i] & bit) != 0
        shared = same & (split if bands[1] >= 0 else ~split)
        first = shared.argmax(1)
        ok = first == bands[0]
        if bands[1] >= 0:
            shared[np.arange(len(j)), first] = False
            ok &= shared.argmax(1) == bands[1]
        j = j[ok]
        if len(j) > 8:
            if flat is None:  # the bucket's shingles as small numbers, so that many intersections are one pass over marks
                edge = np.concatenate([[0], np.cumsum([len(s) for s, _ in sets])])
                flat = np.unique(np.concatenate([s for s, _ in sets]), return_inverse=True)[1]
                ids = np.zeros(int(flat.max(initial=0)) + 1, bool)
            ids[flat[edge[i] : edge[i + 1]]] = True
            both = np.array([ids[flat[edge[k] : edge[k + 1]]].sum() for k in j.tolist()])
            ids[flat[edge[i] : edge[i + 1]]] = False
            maybe = (len(sets[i][0]) - both <= both * top[i] * slack + 1e-9) & (edge[j + 1] - edge[j] - both <= both * top[j] * slack + 1e-9)
            j = j[maybe]
        for k in j.tolist():
            if lab[k] != lab[i] and similarity(sets[i], sets[k]) >= least:
                out.append((int(min(nid[i], nid[k])), int(max(nid[i], nid[k]))))
                lab[lab == lab[k]] = lab[i]
    return out


_ROW = ("k", "x", "y", "block", "j", "j2", "nid", "comp", "n", "sig", "mask", "text")


def _compared(rows: DataFrame, groups: int, least: float, equal: int) -> DataFrame:
    """Links (u, v) inside each group (k, x, y) of rows _ROW."""

    def links(held: list[tuple[pa.RecordBatch, list]]) -> list[tuple[int, int]]:
        t = pa.Table.from_batches([b for b, _ in held])
        nid, comp, n, block, mask = (t[c].to_numpy() for c in ("nid", "comp", "n", "block", "mask"))
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, REGISTERS + 4 * BANDS)
        sig, marks = sig[:, :REGISTERS], sig[:, REGISTERS:].copy().view(np.uint32)
        at = [t[c][0].as_py() for c in ("j", "j2", "x", "y")]
        return _linked(nid, comp, n, block, sig, marks, mask, at[:2], at[2], at[3], [s for _, v in held for s in v], least, equal)

    def run(batches):
        held: list[tuple[pa.RecordBatch, list]] = []
        now = None
        out: list[tuple[int, int]] = []
        for b in batches:
            sets = _sets(K.column(b, "text"))
            b = b.drop_columns(["text"])
            key = np.stack([K.column(b, c).to_numpy() for c in ("k", "x", "y")], 1)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(edge, edge[1:]):
                if i == j:
                    continue
                if held and tuple(key[i]) != now:
                    out += links(held)
                    held = []
                now = tuple(key[i])
                held.append((b.slice(i, j - i), sets[i:j]))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out]), pa.array([p[1] for p in out])], names=["u", "v"])
                out = []
        if held:
            out += links(held)
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["u", "v"])

    return rows.select(*_ROW).repartition(groups, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(K.tidy(run), "u long, v long")


def _lone(nid, comp, block, sig, marks, x: int, y: int, equal: int):
    """Pairs of members of blocks x and y of one bucket that share no other band, of different components, with enough equal registers."""
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    own, labels = np.ascontiguousarray(marks[right].T), comp[right]
    for i in left.tolist():
        j = right[((own == marks[i][:, None]).sum(0, dtype=np.uint8) == 1) & (labels != comp[i])]
        j = j[j > i] if x == y else j
        j = j[(sig[j] == sig[i]).sum(1) >= equal]
        if len(j):
            yield np.full(len(j), nid[i]), nid[j]


def _alone(rows: DataFrame, groups: int, equal: int) -> DataFrame:
    """The pairs (u, v) of _lone inside each group (k, x, y) of rows (k, x, y, block, nid, comp, sig)."""

    def pairs(held: list[pa.RecordBatch]):
        t = pa.Table.from_batches(held)
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(-1, REGISTERS + 4 * BANDS)
        sig, marks = sig[:, :REGISTERS], sig[:, REGISTERS:].copy().view(np.uint32)
        return _lone(*(t[c].to_numpy() for c in ("nid", "comp", "block")), sig, marks, t["x"][0].as_py(), t["y"][0].as_py(), equal)

    def run(batches):
        held: list[pa.RecordBatch] = []
        now = None

        def found():
            us, vs, n = [], [], 0
            for u, v in pairs(held):
                us, vs, n = [*us, u], [*vs, v], n + len(u)
                if n > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])
                    us, vs, n = [], [], 0
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for b in batches:
            key = np.stack([K.column(b, c).to_numpy() for c in ("k", "x", "y")], 1)
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for i, j in zip(edge, edge[1:]):
                if i == j:
                    continue
                if held and tuple(key[i]) != now:
                    yield from found()
                    held = []
                now = tuple(key[i])
                held.append(b.slice(i, j - i))
        if held:
            yield from found()

    return rows.select("k", "x", "y", "block", "nid", "comp", "sig").repartition(groups, "k", "x", "y").sortWithinPartitions("k", "x", "y").mapInArrow(K.tidy(run), "u long, v long")


def _met(rows: DataFrame) -> DataFrame:
    """rows of buckets k of `parts` blocks, once for each block that a row's own meets: block, x and y."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("nid", "k"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})


def classes(docs: DataFrame, block: int = BLOCK, least: float = LEAST, equal: int = LEAST_EQUAL) -> DataFrame:
    """doc_id, nid and class_id for each row of docs. equal: the equal registers of 96 below which a pair isn't compared in the second pass; 0
    compares all that share a band."""
    return _classes(docs, block, least, equal)[0]


def _classes(docs: DataFrame, block: int = BLOCK, least: float = LEAST, equal: int = LEAST_EQUAL, avoid: list[int] | None = None) -> tuple[DataFrame, list[int]]:
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = cut(sketch(docs, avoid or []))
    if avoid is None:
        # Two hashes tell whether different texts share a number. Of 10**10 texts about three pairs do; they are numbered anew.
        clash = raw.where("nid2 is not null").groupBy("nid").agg(F.min("nid2").alias("a"), F.max("nid2").alias("b")).where("a <> b").select("nid").limit(MOST_CLASHES + 1)
        clash = [r["nid"] for r in clash.collect()]
        if len(clash) > MOST_CLASHES:
            raise RuntimeError("more texts share a hash than chance allows")
        if clash:
            return _classes(docs, block, least, equal, clash)
    avoid = avoid or []
    key = ["nid", "plain"]  # of a sketch
    one = cut(raw.where("bands is not null").groupBy(key).agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    band = one.select(*key, "n", F.posexplode("bands").alias("j", "k"))
    met = band.groupBy("k").agg(F.count("*").alias("members"), F.sum("n").alias("volume"), F.min("nid").alias("a"), F.max("nid").alias("b"))
    mates = cut(band.join(cut(met.where("a <> b").drop("a", "b")), "k"))
    # First pass: every member of a bucket with its leader.
    lead = mates.groupBy(key).agg(F.sum("members").alias("mates"))
    lead = cut(mates.join(lead, key).groupBy("k").agg(F.max(F.struct("mates", "nid")).alias("best")).select("k", F.col("best.nid").alias("v")))
    links = verified(mates.join(lead, "k").select(F.col("nid").alias("u"), "v"), docs, least, avoid)
    root = components(links)
    # Second pass: buckets that hold more than one component. A bucket too large for one task is split by a second band that is shared.
    of = mates.join(root.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")
    mixed = of.groupBy("k").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("k")
    parted = F.ceil(F.greatest(F.col("members") / block, F.col("volume") / (block * 2048)))
    of = cut(of.join(cut(mixed), "k", "left_semi").withColumn("parts", parted.cast("int")))
    big = of.where("parts > 1").groupBy(*key, "comp", "n").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("ks"), F.sum(F.expr("shiftleft(1, j)")).cast("int").alias("mask"))
    big = cut(big)
    two = F.flatten(F.transform("ks", lambda a, i: F.transform(F.slice("ks", i + 2, BANDS), lambda b: F.struct(a["j"].alias("j"), b["j"].alias("j2"), F.xxhash64(a["k"], b["k"]).alias("k")))))
    pairs = big.select(*key, "comp", "n", "mask", F.explode(two).alias("p")).select(*key, "comp", "n", "mask", "p.*")
    many = pairs.groupBy("k").agg(F.count("*").alias("members"), F.sum("n").alias("volume"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("k", parted.cast("int").alias("parts"))
    cols = ["k", "j", "j2", *key, "comp", "n", "mask", "parts"]
    rows = of.where("parts <= 1").withColumn("j2", F.lit(-1)).join(big.select(*key, "mask"), key, "left").withColumn("mask", F.coalesce("mask", F.lit(0))).select(cols)
    rows = cut(rows.unionByName(pairs.join(cut(many), "k").select(cols)))
    rows = _met(rows).join(one.select(*key, "sig"), key).join(_texts(rows.select("nid"), docs, avoid), "nid")
    more = cut(_compared(rows, parts, least, equal).distinct())
    if not more.isEmpty():
        links = cut(links.unionByName(more))
        root = components(links)
    # Third pass: pairs that share the band of a split bucket alone, so that the second pass compared them nowhere.
    split = of.where("parts > 1")
    if not split.isEmpty():
        split = split.select("k", *key, "members").join(root.withColumnRenamed("node", "nid"), "nid", "left").withColumn("comp", F.coalesce("root", "nid")).drop("root")
        mixed = split.groupBy("k").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("k")
        split = split.join(mixed, "k", "left_semi").withColumn("parts", F.ceil(F.col("members") / (block * WIDE)).cast("int"))
        rest = verified(_alone(_met(split).join(one.select(*key, "sig"), key), parts, equal), docs, least, avoid)
        if not rest.isEmpty():
            root = components(links.unionByName(rest))
    # Texts have their component's root; rows the lowest id of their class.
    of = cut(raw.where("not plain").select("doc_id", "nid").join(root.withColumnRenamed("node", "nid"), "nid", "left").join(
        one.where("not plain").select("nid", F.lit(True).alias("has")), "nid", "left").select("doc_id", "nid", F.when(F.col("has"), F.coalesce("root", "nid")).alias("root")))
    name = small(cut(of.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("rows")).where("rows > 1").select("root", "class_id")))
    return of.join(name, "root", "left").select("doc_id", "nid", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("root").isNotNull().alias("has_words")), avoid


def keep_one(docs: DataFrame, block: int = BLOCK, least: float = LEAST, equal: int = LEAST_EQUAL) -> DataFrame:
    """docs with one row of each of its `classes`: the one with the lowest id (of equal ids, the text with the lowest hash; of equal rows, any). Rows
    without a word all stay. equal = 0 compares all pairs that share a band."""
    found, avoid = _classes(docs, block, least, equal)
    stay = found.where("has_words").groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "nid")).alias("best"))
    stay = cut(stay.select(F.col("best.doc_id").alias("_doc"), F.col("best.nid").alias("_nid")))
    # Columns of docs travel in a struct, so that none can clash.
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("doc"), _nid(avoid).alias("own"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("has"))
    kept = own.where("has").join(stay, (F.col("own") == F.col("_nid")) & F.col("doc").eqNullSafe(F.col("_doc")))
    twice = found.where("has_words").groupBy("doc_id", "nid").count().where("count > 1")
    if not twice.isEmpty():  # rows with the same id and text: one of them
        w = Window.partitionBy("own", "doc").orderBy(F.xxhash64("row"))
        kept = kept.withColumn("n", F.row_number().over(w)).where("n = 1")
    return kept.select("row.*").unionByName(own.where("not has").select("row.*"))
