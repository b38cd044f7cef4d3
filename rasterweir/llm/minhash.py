"""Near-duplicate documents: BagMinHash signatures, banding, and verified multiset overlap of word shingles.

BagMinHash: a weight is cut into unit steps (the discretisation), which are covered by the dyadic intervals [0,1),
[1,2), [2,4), ... Each shingle has one Poisson process per interval whose rate is the interval's length; the points
of an interval find their place in it by repeated halving, and those above the document's weight are left out. A
point falls on a random register, which keeps its earliest point. Two documents agree in a register with the
probability of their weighted Jaccard similarity. A process is followed only as long as its points can still be a
register's earliest.

Classes: texts with equal word sequences collapse first into word classes with ids of their own. In each band's bucket
the member that collides most is the leader, and the others are verified against it: one link per member, never a
bucket's pairs. Buckets that then still span several components are resolved exactly by blocks (members outside the
largest component against all), each block in one bounded task that keeps spanning links only. Where a bucket has many
such members, as when thousands of pages share a template but are no near copies, blocks would be all pairs. Such members
meet by rare shingles instead (prefix filter): a link shares one of the rarest shingles of both at a place from which
enough of both is left to overlap. That loses no link, and pages whose own text is rare don't meet at all. Documents get
their classes at the very end, so that rows that repeat an id lose no link.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _chunks
from .shared import connected_components, discard, memory_bytes, written


@dataclass(frozen=True)
class NearParams:
    """words: of a shingle. similarity: least weighted Jaccard of a link. bands x rows: registers of a signature.
    block: rows of one side of a verification task. slack: standard errors that a signature's estimate may be low by
    before a pair is verified. outsiders: members outside the main component up to which a bucket is compared in blocks.
    """

    words: int = 5
    similarity: float = 0.8
    bands: int = 26
    rows: int = 5
    block: int = 128
    slack: float = 5.0
    outsiders: int = 128


WORD_CACHE = 300_000
#: Counters (a power of two) that order shingles by frequency; they are broadcast. Any order gives the same links.
COUNTER_BITS = 18
#: Rows of a task that looks for pairs, and pairs that it holds at a time.
TILE_ROWS, PAIRS = 50_000, 1 << 20
#: The ids of documents that share a bucket are broadcast if they take so much memory at most (ID_BYTES a row, counted),
#: so that only their texts are moved; beyond it, texts and ids are joined by shuffle.
BROADCAST_BYTES = 64 << 20
ID_BYTES = 32
_words: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-cased words between white space."""
    if len(_words) > WORD_CACHE:
        _words.clear()
    found = text.lower().split()
    get, put = _words.get, _words.__setitem__
    out = [get(w) for w in found]
    if None in out:
        for i, w in enumerate(found):
            if out[i] is None:
                put(w, h := xxhash.xxh64_intdigest(w.encode("utf-8", "replace")))
                out[i] = h
    return np.array(out, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs. A text of fewer words is one shingle; without words, none."""
    h = word_hashes(text or "")
    if not len(h):
        return h, np.zeros(0, np.int64)
    k = min(words, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        s = _mix(s + h[j : j + len(s)] + np.uint64(0x9E3779B97F4A7C15))
    s.sort()
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(np.append(first, len(s)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """BagMinHash signatures (documents x registers, 32-bit fingerprints of the earliest points). Each bag has a shingle."""
    sizes = np.array([len(u) for u, _ in bags])
    u = np.concatenate([x for x, _ in bags])
    w = np.concatenate([x for _, x in bags])
    doc = np.repeat(np.arange(len(bags)), sizes)
    weight = np.add.reduceat(w, np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype(float)
    best, mark = np.full(len(bags) * registers, np.inf), np.zeros(len(bags) * registers, np.uint32)
    horizon = registers * (np.log(registers) + 3) / weight  # nearly all registers are hit by then
    # one process per shingle and dyadic interval that begins below its weight
    parts, lo, length = [], 0, 1
    while (at := np.flatnonzero(w > lo)).size:
        parts.append((doc[at], u[at], w[at], np.full(len(at), lo), np.full(len(at), length)))
        lo, length = lo + length, length if lo == 0 else 2 * length
    d0, u0, w0, lo0, len0 = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed = _mix(u0 ^ _mix((lo0 + 1).astype(np.uint64)))
    open_docs = np.ones(len(bags), bool)
    reach = horizon.copy()
    while open_docs.any():
        at = np.flatnonzero(open_docs[d0])
        d, s, ww, lo, ln = d0[at], seed[at], w0[at], lo0[at], len0[at]
        t, k = np.zeros(len(at)), 0
        while len(d):
            k += 1
            x = _mix(s + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(_uniform(x)) / ln
            live = t <= reach[d]
            d, s, ww, lo, ln, t, x = d[live], s[live], ww[live], lo[live], ln[live], t[live], x[live]
            if not len(d):
                break
            y = _mix(x ^ np.uint64(0xD6E8FEB86659FD93))
            slot = d * registers + (y % np.uint64(registers)).astype(np.int64)
            hit = t < best[slot]
            if (ln > 1).any():  # halving: bits of a hash choose the half again and again
                place = lo + (_mix(y) % ln.astype(np.uint64)).astype(np.int64)  # ln is a power of two: its low bits
                hit &= place < ww
            np.minimum.at(best, slot[hit], t[hit])
            own = hit & (best[slot] == t)
            mark[slot[own]] = (y[own] >> np.uint64(32)).astype(np.uint32)
        open_docs = np.isinf(best.reshape(len(bags), registers)).any(axis=1)
        reach[open_docs] *= 2
        again = np.flatnonzero(open_docs)
        best.reshape(len(bags), registers)[again] = np.inf
    return mark.reshape(len(bags), registers)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset overlap: sum of the smaller counts over sum of the larger."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    same = np.flatnonzero(a[0][at] == b[0]) if len(a[0]) else np.zeros(0, np.int64)
    both = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return both / (total - both)


def _roots(n: int) -> tuple[list[int], object]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, find


def _words_key(text: str | None) -> bytes | None:
    """128 bits of the text's word sequence; none without words."""
    own = " ".join((text or "").lower().split())
    return xxhash.xxh128_digest(own.encode("utf-8", "replace")) if own else None


def near_groups(docs: DataFrame, params: NearParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id, kept)``: one row for each input row; ``class_id`` is the smallest id of its class, which is kept.

    A class is a connected component of the documents by links of weighted Jaccard >= ``similarity`` over word
    shingles. Rows with equal word sequences always share a class. Null texts and texts without words are classes of
    their own. Rows that repeat an id are one document: each keeps its row, and the links of all its texts count. Rows
    with a null id: ``class_id`` null, kept. Ids are of any type with an order, strings too. A very long text is signed and verified whole. Other columns are ignored,
    whatever their names; an empty table gives no rows. The tables that the result reads stay in the shared folder
    (hashes and ids); the others, texts among them, are deleted.
    """
    p = params or NearParams()
    registers = p.bands * p.rows
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    # 1. word classes, numbered when they are written
    def word_key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_words_key(x) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "words"])

    keyed = written(rows.mapInArrow(word_key, f"doc_id {kind}, words binary"), "word-keys")
    known = keyed.where("words IS NOT NULL AND doc_id IS NOT NULL")
    firsts = written(known.groupBy("words").agg(F.min("doc_id").alias("first")).withColumn("rep", F.monotonically_increasing_id()), "word-classes")

    # 2. signatures of the word classes, as bands; copies within a batch are signed once
    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches, "text", 4 << 20):
            own = {k: x for x in b.column(0).to_pylist() if (k := _words_key(x))}
            if not own:
                continue
            sig = np.ascontiguousarray(signatures([shingles(x, p.words) for x in own.values()], registers))
            bands = np.zeros((len(own), p.bands), np.uint64)
            for j in range(p.rows):
                bands = _mix(bands + sig[:, j :: p.rows].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            bands = _mix(bands ^ np.arange(p.bands, dtype=np.uint64)).astype(np.int64)
            at = pa.array(np.arange(len(own) + 1, dtype=np.int32) * p.bands)
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary()), pa.ListArray.from_arrays(at, pa.array(bands.ravel()))], names=["words", "sig", "bands"])

    signed = rows.where("doc_id IS NOT NULL").select("text").mapInArrow(sign, "words binary, sig binary, bands array<long>").dropDuplicates(["words"])
    signed = written(signed.join(firsts, "words").select("rep", "sig", "bands"), "signatures")
    banded = signed.select("rep", F.explode("bands").alias("band"))
    full = banded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    banded = written(banded.join(full, "band"), "bands")

    # 3. links to the bucket's leader: the member that collides most
    busy = banded.groupBy("rep").agg(F.sum("size").alias("busy"))
    ranked = banded.join(busy, "rep").select("band", "rep", F.struct("busy", F.negative("rep").alias("neg")).alias("rank"))
    leaders = ranked.groupBy("band").agg(F.negative(F.max("rank")["neg"]).alias("leader"))
    star = written(banded.join(leaders, "band").where("rep <> leader").groupBy("leader", "rep").agg(F.max("size").alias("size")), "star")
    members = star.select("rep").union(star.select("leader")).distinct()
    members = written(members.join(firsts, "rep"), "members")
    ids = members.select(F.col("first").alias("doc_id")).distinct()
    if memory_bytes(members, ID_BYTES) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)

    def keyed_text(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([pa.array([_words_key(x) for x in b.column(0).to_pylist()], pa.binary()), b.column(0)], names=["words", "text"])

    texts = rows.join(ids, "doc_id", "left_semi").select("text").mapInArrow(keyed_text, "words binary, text string")
    texts = written(texts.join(members.select("words", "rep"), "words").select("rep", "text").dropDuplicates(["rep"]), "member-texts")
    links = written(_verified(star, texts, p), "links")

    # 4. buckets that are not one component yet
    comp = written(connected_components(links), "component")
    named = banded.select("band", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named, "named")
    split = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi AND members > 2")
    sizes = named.join(split.select("band"), "band", "left_semi").groupBy("band", "component").agg(F.count("*").alias("n"))
    most = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("most"), F.sum("n").alias("members")).select("band", F.col("most.component").alias("main"), F.col("most.n").alias("main_n"), "members")
    many = F.col("members") - F.col("main_n") > p.outsiders
    more = _resolved(named.join(most.where(~many), "band"), signed, texts, p)
    crowd = written(named.join(most.where(many), "band", "left_semi").select("rep", "component").distinct(), "crowd")
    if not crowd.isEmpty():
        pairs = written(_close(_prefix_pairs(crowd, texts, p), signed, p), "pairs")
        more = more.union(_verified(pairs, texts, p))
    more = written(more, "more-links")

    # 5. texts of one document belong together; then classes of documents
    several = known.groupBy("doc_id").agg(F.min("words").alias("low"), F.max("words").alias("high")).where("low <> high")
    same = known.join(several, "doc_id").where("words <> low").select("words", "low").distinct()
    same = same.join(firsts.select("words", F.col("rep").alias("a")), "words").join(firsts.select(F.col("words").alias("low"), F.col("rep").alias("b")), "low")
    comp = written(connected_components(links.unionByName(more).unionByName(same.select("a", "b"))), "component")
    discard(signed, banded, star, members, texts, named, links, more, crowd)
    linked = comp.join(firsts.select(F.col("rep").alias("id"), "first"), "id")
    linked = linked.join(linked.groupBy("component").agg(F.min("first").alias("class_id")), "component").select(F.col("id").alias("rep"), "class_id")
    final = firsts.join(linked, "rep", "left").select("words", F.coalesce("class_id", "first").alias("class_id"))
    out = keyed.join(final, "words", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def _verified(star: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Links ``(a, b)`` of ``star(leader, rep, size)`` that reach the similarity.

    A leader's members are dealt to parts by a hash and the size class of the bucket they met in, so no step gathers all
    members of a leader in a task and none needs to count them.
    """
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("size") / p.block, F.lit(1.0))))).cast("long")
    dealt = star.select("leader", parts.alias("parts"), "rep").select("leader", "parts", F.pmod(F.xxhash64("rep"), "parts").alias("part"), "rep")
    wanted = dealt.union(dealt.select("leader", "parts", "part", F.col("leader").alias("rep")).distinct())

    def check(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        leader = int(key[0])
        own = shingles(next((x for r, x in zip(pdf["rep"], pdf["text"], strict=True) if r == leader), None), p.words)
        good = [int(r) for r, x in zip(pdf["rep"], pdf["text"], strict=True) if r != leader and weighted_jaccard(own, shingles(x, p.words)) >= p.similarity]
        return pd.DataFrame({"a": np.full(len(good), leader, np.int64), "b": np.array(good, np.int64)})

    return wanted.join(texts, "rep").groupBy("leader", "parts", "part").applyInPandas(check, "a long, b long")


def _resolved(open_rows: DataFrame, signed: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """Spanning links between components of a bucket: members outside the main component against all members, in blocks.

    ``open_rows(band, rep, component, main, main_n, members)``. A pair of blocks is one task; signatures rule out what
    is ``slack`` standard errors too far, the rest is verified on the texts; pairs that are connected already are skipped.
    """
    n_out = F.ceil((F.col("members") - F.col("main_n")) / p.block).cast("int")
    n_all = F.ceil(F.col("members") / p.block).cast("int")
    spot = F.pmod(F.xxhash64("rep", "band"), F.lit(1 << 30))
    base = open_rows.select("band", "rep", "component", (F.col("component") != F.col("main")).alias("outside"), n_out.alias("n_out"), n_all.alias("n_all"), spot.alias("spot"))
    left = base.where("outside").select("band", "rep", "component", F.pmod("spot", "n_out").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(True).alias("query"))
    right = base.select("band", "rep", "component", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), F.pmod("spot", "n_all").cast("int").alias("j"), F.lit(False).alias("query"))
    full = left.unionByName(right).join(signed.select("rep", "sig").join(texts, "rep"), "rep")
    registers = p.bands * p.rows
    least = p.similarity - p.slack * (p.similarity * (1 - p.similarity) / registers) ** 0.5

    def check(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["rep", "query"])
        q, x = pdf[pdf["query"]], pdf[~pdf["query"]]
        sig_x = np.stack([np.frombuffer(s, np.uint32) for s in x["sig"]]) if len(x) else np.zeros((0, registers), np.uint32)
        names = {c: i for i, c in enumerate(pd.unique(pdf["component"]))}
        parent, find = _roots(len(names))
        bags: dict[int, tuple] = {}
        text = dict(zip(pdf["rep"], pdf["text"], strict=True))

        def bag(r: int) -> tuple:
            if r not in bags:
                bags[r] = shingles(text[r], p.words)
            return bags[r]

        out, x_rep, x_comp = [], x["rep"].to_numpy(), [names[c] for c in x["component"]]
        for r, c, s in zip(q["rep"], q["component"], q["sig"], strict=True):
            near = (sig_x == np.frombuffer(s, np.uint32)).mean(axis=1) if len(x) else np.zeros(0)
            for k in np.flatnonzero(near >= least)[np.argsort(-near[near >= least], kind="stable")]:
                i, j = find(names[c]), find(x_comp[k])
                if i != j and weighted_jaccard(bag(r), bag(x_rep[k])) >= p.similarity:
                    parent[max(i, j)] = min(i, j)
                    out.append((int(r), int(x_rep[k])))
        return pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)

    return full.groupBy("band", "i", "j").applyInPandas(check, "a long, b long")


def tokens(text: str | None, words: int) -> np.ndarray:
    """A bag of shingles as a set: the k-th occurrence of a shingle is an element of its own."""
    u, n = shingles(text, words)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return _mix(np.repeat(u, n) ^ _mix(at.astype(np.uint64)))


def _frequencies(rows: DataFrame, p: NearParams) -> np.ndarray:
    """How many elements of all texts fall on each of 2 ** COUNTER_BITS counters; summed in blocks by Spark."""
    size, block = 1 << COUNTER_BITS, 1 << 12

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                sums += np.bincount((tokens(x.as_py(), p.words) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=size)
        used = np.flatnonzero(sums.reshape(-1, block).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([x.tobytes() for x in sums.reshape(-1, block)[used]], pa.binary())], names=["block", "sums"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "sums": [np.sum([np.frombuffer(x, np.int64) for x in pdf["sums"]], axis=0).tobytes()]})

    out = np.zeros((size // block, block), np.int64)
    for r in rows.select("text").mapInArrow(tally, "block int, sums binary").groupBy("block").applyInPandas(add, "block int, sums binary").collect():  # 2 ** COUNTER_BITS numbers
        out[r["block"]] = np.frombuffer(r["sums"], np.int64)
    return out.ravel()


def _prefix(own: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The rarest elements of a set of which a link shares one, and for each the size up to which a set may be that meets this one there first."""
    n = len(own)
    order = np.lexsort((own, counts[(own >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
    first = order[: n - int(np.ceil(similarity * n - 1e-9)) + 1]
    # overlap that is left from a place on >= s / (1 + s) * (both sizes)
    left = n - np.arange(len(first))
    return own[first], np.floor(left * (1 + similarity) / similarity - n + 1e-6).astype(np.int64)


def _prefix_pairs(crowd: DataFrame, texts: DataFrame, p: NearParams) -> DataFrame:
    """``(a, b)``: pairs of ``crowd(rep, component)`` of different components that may reach the similarity; none that does is missing.

    Rows ``(element, rep, component, size, cap)`` meet by element. An element on which no set could meet one of its own size or larger is
    dropped, and so are those of one component. What remains of an element is dealt in blocks, members outside its largest component
    against all, and blocks are dealt to tasks of about TILE_ROWS rows.
    """
    rows = texts.join(crowd, "rep").select("text", "rep", "component")
    counts = rows.sparkSession.sparkContext.broadcast(_frequencies(rows, p))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _chunks(batches, "text", 4 << 20):
            found = [(tokens(x.as_py(), p.words), r, c) for x, r, c in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            parts = [(*_prefix(own, counts.value, p.similarity), r, c, len(own)) for own, r, c in found if len(own)]
            if parts:
                n = [len(x[0]) for x in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in parts]).view(np.int64)), *(pa.array(np.repeat(np.array([x[k] for x in parts], np.int64), n)) for k in (2, 3, 4)), pa.array(np.concatenate([x[1] for x in parts]))],
                    names=["element", "rep", "component", "size", "cap"],
                )

    met = written(rows.mapInArrow(first, "element long, rep long, component long, size long, cap long"), "prefixes")
    shape = met.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"), F.max(F.col("cap") >= F.col("size")).alias("meets"))
    shape = shape.where("lo <> hi AND meets").select("element", "members")
    met = written(met.join(shape, "element"), "prefixes-met")
    sizes = met.groupBy("element", "component").agg(F.count("*").alias("n"), F.max("members").alias("members"))
    most = sizes.groupBy("element").agg(F.max(F.struct("n", "component")).alias("most")).select("element", F.col("most.component").alias("main"), F.col("most.n").alias("main_n"))
    wide = 4 * p.block
    n_out, n_all = (F.greatest(F.lit(1), F.ceil(x / wide)).cast("int") for x in (F.col("members") - F.col("main_n"), F.col("members")))
    base = met.join(most, "element").withColumns({"outside": F.col("component") != F.col("main"), "n_out": n_out, "n_all": n_all, "spot": F.pmod(F.xxhash64("rep", "element"), F.lit(1 << 30))})
    names = ["element", "rep", "component", "size", "cap"]
    left = base.where("outside").select(*names, F.pmod("spot", "n_out").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), F.lit(True).alias("query"))
    right = base.select(*names, F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), F.pmod("spot", "n_all").cast("int").alias("j"), F.lit(False).alias("query"))
    both = left.unionByName(right)
    tiles = max(1, -(-met.count() // TILE_ROWS))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["element", "i", "j"], kind="stable")
        ident = pdf[["element", "i", "j"]].to_numpy()
        group = np.cumsum(np.append(True, (ident[1:] != ident[:-1]).any(axis=1))) - 1
        query = pdf["query"].to_numpy(bool)
        rep, comp, size, cap = (pdf[c].to_numpy() for c in ("rep", "component", "size", "cap"))
        x, y = np.flatnonzero(query), np.flatnonzero(~query)
        per = np.bincount(group[y], minlength=group[-1] + 1)
        start = np.append(0, np.cumsum(per))[:-1]
        out, at = [], np.cumsum(per[group[x]])
        cuts = [0, *np.unique(np.searchsorted(at, np.arange(PAIRS, at[-1] if len(at) else 0, PAIRS), side="right")), len(x)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            k = per[group[x[lo:hi]]]
            i = np.repeat(x[lo:hi], k)
            j = y[np.repeat(start[group[x[lo:hi]]], k) + np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)]
            good = (comp[i] != comp[j]) & (size[j] <= cap[i]) & (size[i] <= cap[j]) & (np.minimum(size[i], size[j]) >= p.similarity * np.maximum(size[i], size[j]) - 1e-9)
            out.append(np.unique(np.stack([np.minimum(rep[i[good]], rep[j[good]]), np.maximum(rep[i[good]], rep[j[good]])], axis=1), axis=0))
        got = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1]})

    found = both.withColumn("tile", F.pmod(F.xxhash64("element", "i", "j"), F.lit(tiles))).groupBy("tile").applyInPandas(meet, "a long, b long").distinct()
    found = written(found, "prefix-pairs")
    discard(met)
    return found


def _close(pairs: DataFrame, signed: DataFrame, p: NearParams) -> DataFrame:
    """``(leader, rep, size)`` of the pairs whose signatures aren't ``slack`` standard errors too far apart; only these move texts."""
    least = p.similarity - p.slack * (p.similarity * (1 - p.similarity) / (p.bands * p.rows)) ** 0.5

    def agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.array([np.frombuffer(v.as_py(), np.uint32) for v in b.column(k)]).reshape(b.num_rows, -1) for k in (2, 3))
            good = pa.array((x == y).mean(axis=1) >= least) if b.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["leader", "rep"])

    sig = signed.select("rep", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    close = both.mapInArrow(agree, "leader long, rep long")
    return close.join(close.groupBy("leader").agg(F.count("*").alias("size")), "leader").select("leader", "rep", "size")


def keep_one(docs: DataFrame, params: NearParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id. All columns pass through.

    Rows are told apart by id alone: those that repeat the id that stays all stay. Rows with a null id stay, and so do
    those without words. An empty table stays empty.
    """
    mark = f"_kept_{uuid.uuid4().hex}"
    kept = near_groups(docs, params, id_col, text_col).where("kept").select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(mark)), "left_semi")
