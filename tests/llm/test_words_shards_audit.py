"""Spelling variants, jump sharding and the filter audit against brute force, and on awkward rows."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_operators import AWKWARD, DOCS, awkward, empty

from rasterweir.llm import audit, queries, sharding, spelling

# ---- 11 spelling variants -----------------------------------------------------------------------------------------------


def edits(word):
    """All texts that one deletion makes, with a mark where the letter was (replacement) or without (deletion)."""
    return [(word[:i] + "\0" + word[i + 1 :], word[:i] + word[i + 1 :]) for i in range(len(word))]


def near_by_hand(words):
    """Pairs one edit apart, by patterns with one open place."""
    words, out, held = set(words), set(), collections.defaultdict(set)
    for w in words:
        for hole, less in edits(w):
            held[hole].add(w)
            if less in words:
                out.add(tuple(sorted((w, less))))
    for group in held.values():
        out |= {tuple(sorted(p)) for p in itertools.combinations(sorted(group), 2)}
    return out


def counts_by_hand(docs):
    n = collections.Counter()
    for doc_id, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def variants_by_hand(docs):
    n = counts_by_hand(docs)
    near = collections.defaultdict(set)
    for a, b in near_by_hand(n):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_variants_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, DATA).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == variants_by_hand(docs.collect()) and any(x[1] for x in got)


@pytest.mark.parametrize("block", [2, 8, 256])
def test_large_groups_are_divided_without_loss(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(7)
    words = {"anfang" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(300)}
    words |= {"".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) + "schluss" for _ in range(200)}
    words |= {"x", "y", "xy", "é" * 6, "é" * 7, "l" * 3000, "l" * 2999, "l" * 1500 + "m" + "l" * 1499}
    frame = spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], "word string")
    got = [tuple(sorted(r)) for r in spelling.near_words(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == near_by_hand(words)


def test_rows_of_one_prefix_grow_with_the_words(spark):
    """A prefix that all words share doesn't make rows by the square."""
    made = []
    for n in (1000, 4000):
        words = spark.range(n).select(F.concat(F.lit("gemeinsam"), F.translate(F.lpad(F.conv("id", 10, 26), 4, "0"), "0123456789", "qrstuvwxyz")).alias("word"))
        sizes = []
        original = spelling._compared
        spelling._compared = lambda met, seen=sizes, run=original: (seen.append(met.count()), run(met))[1]
        try:
            spelling.near_words(words).count()
        finally:
            spelling._compared = original
        made.append(sum(sizes))
    assert made[1] < 6 * made[0]


def test_variants_of_awkward_rows(spark):
    text = "Straßen STRASSEN×÷ Größe größer größen GRÖSSEN " * 40
    rows = [*AWKWARD, (8, text, "de", "a", len(text)), (None, text, "de", "a", len(text)), (8, text, "de", "a", len(text)), (9, "wörter" * 30_000, "de", "a", 1)]
    got = {tuple(r) for r in spelling.variants(spark.createDataFrame(rows, DOCS).withColumn("word", F.lit("x"))).collect()}
    assert got == variants_by_hand([(r[0], r[1]) for r in rows])
    assert spelling.variants(empty(spark)).count() == 0
    assert list(itertools.chain(*spelling.runs_of("ab" * (1 << 20) + " c"))) == ["ab" * (1 << 20), "c"]


# ---- 12 sharding --------------------------------------------------------------------------------------------------------


def jump(key, n):
    """The published loop."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def first_half(text):
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:16], 16)


@pytest.mark.parametrize("shards", [1, 2, 24, 63, 64, 1000])
def test_shards_equal_the_published_loop(spark, shards):
    got = sharding.assign(spark.range(400).withColumnRenamed("id", "doc_id"), shards).collect()
    assert [(r.shard, r.grown_shard) for r in got] == [(jump(k := first_half(str(r.doc_id)), shards), jump(k, shards + 1)) for r in got]


def test_walks_that_need_the_second_stage(spark, monkeypatch):
    monkeypatch.setattr(sharding, "WALK", 3)
    got = sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), 50, 80).collect()
    assert [(r.shard, r.grown_shard) for r in got] == [(jump(k := first_half(str(r.doc_id)), 50), jump(k, 80)) for r in got]


def test_appended_shard_takes_rows_only_into_itself(spark):
    got = sharding.assign(spark.range(20_000).withColumnRenamed("id", "doc_id"), 24).toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and 0.03 < len(moved) / len(got) < 0.05
    assert set(got["shard"]) == set(range(24)) and got["shard"].value_counts().min() > 20_000 / 24 * 0.85


@pytest.mark.parametrize("range_rows", [3, 50_000])
def test_layout_has_gapless_places(spark, monkeypatch, range_rows):
    monkeypatch.setattr(sharding, "RANGE_ROWS", range_rows)
    rows = spark.createDataFrame([*AWKWARD, *[(50, "gleich", "de", "a", 6)] * 40], DOCS).withColumns({"slot": F.lit("x"), "size": F.lit(1), "n": F.lit(2), "part": F.lit(3)})
    got = sharding.layout(rows, 4).toPandas()
    assert len(got) == len(AWKWARD) + 40 and set(got["law"]) == {"key"}
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    want = collections.Counter((None if r[0] is None else r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in [*AWKWARD, *[(50, "gleich")] * 40])
    assert collections.Counter((None if np.isnan(i) else int(i), s, c) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == want
    assert sharding.layout(empty(spark), 4).count() == 0
    with pytest.raises(ValueError, match="shard"):
        sharding.assign(rows, 5, 4)


def test_sharding_has_no_python_and_moves_no_texts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plan = sharding.layout(docs, 24)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "text#" not in plan.split("== Physical Plan ==")[1].replace("text_crc32#", "")


def test_written_shards_are_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "FILE_BYTES", 20_000)
    docs = awkward(spark)
    sharding.write_shards(docs, f"file://{tmp_path}/shards", 5)
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert all(r.shard == jump(first_half("" if r.doc_id is None else str(r.doc_id)), 5) for r in back.select("doc_id", "shard").collect())
    sharding.write_shards(empty(spark), f"file://{tmp_path}/none", 5)


# ---- 13 filter audit ----------------------------------------------------------------------------------------------------


def audit_by_hand(docs, labels):
    """Rows (part, order, step, ...) by applying every order to every document."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({i for i, q, t in labels if (q if k == 0 else t) == 1} for k in (0, 1))
    rows = []
    for i, text, part in docs:
        t = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", t) if w]
        fails = {c for c, f in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), i is not None and i > least[t]), strict=True) if f}
        rows.append((part or "", fails, i in good, i in toxic))
    out, shapley = {}, collections.Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += now
                shapley[part, f] += len(now)
                unique = sum(r[1] == {f} for r in rows if r[0] == part)
                out[part, order, step] = [len(left), len(now), redundant, unique, sum(r[2] for r in now), sum(r[3] for r in now)]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_rows():
    long = " ".join(f"wort{i}" for i in range(60))
    dull = "immer gleich " * 30
    rows = [(9, long, "a"), (3, long, "b"), (5, long, "a"), (3, long, "b"), (3, long, "c"), (None, long, "a"), (None, long, None), (1, None, "a"), (2, "", "a"), (4, dull, "b"), (6, "ABC # d", None), (7, "ABC # d", "b"), (8, dull.upper(), "b")]
    labels = [(9, 1, 0), (3, 1, 1), (5, 0, 1), (5, None, None), (7, 1, 1), (2, None, 1), (None, 1, 1), (99, 1, 1)]
    return rows, labels


@pytest.mark.parametrize(("files", "order"), [(1, 1), (2, 1), (13, 1), (13, -1)])
def test_audit_equals_brute_force_in_any_order_of_files(spark, tmp_path, files, order):
    import os

    rows, labels = audit_rows()
    for k in range(files):
        part = rows[k::files][::order]
        spark.createDataFrame(part, "doc_id long, text string, source string").coalesce(1).write.parquet(f"file://{tmp_path}/in-{k}")
    os.makedirs(tmp_path / "docs")
    for k in range(files)[::order]:
        name = next(f for f in os.listdir(tmp_path / f"in-{k}") if f.endswith(".parquet"))
        os.rename(tmp_path / f"in-{k}" / name, tmp_path / "docs" / f"{k}.parquet")
        os.utime(tmp_path / "docs" / f"{k}.parquet", (1_000_000 + order * k, 1_000_000 + order * k))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit.interactions(audit.counters(spark, f"file://{tmp_path}/docs", table, files_per_batch=4))
    assert {tuple(r) for r in got.collect()} == audit_by_hand(rows, labels)


def test_audit_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).coalesce(1).write.parquet(f"file://{tmp_path}/none")
    assert audit.interactions(audit.counters(spark, f"file://{tmp_path}/none")).count() == 0


def test_smaller_ids_retract():
    import pandas as pd

    columns = audit.ROWS.names
    state = audit.ROWS.empty_table().to_pandas()

    def send(*rows):
        nonlocal state
        state, changes = audit.update(state, pd.DataFrame([(1, 2, *r) for r in rows], columns=columns))
        total = changes.groupby(["part", "mask"])[["n", "good", "toxic"]].sum()
        return {(*k, *v) for k, v in zip(total.index, total.to_numpy().tolist(), strict=True) if any(v)}

    assert send((5, "a", 1, 1, 1, 0)) == {("a", 1, 1, 1, 0)}
    assert send((3, "b", 1, 1, 0, 1)) == {("a", 1, -1, -1, 0), ("a", 17, 1, 1, 0), ("b", 1, 1, 0, 1)}
    assert send((4, "a", 1, 1, 0, 0), (6, "c", 1, 2, 1, 0)) == {("a", 17, 1, 0, 0), ("c", 17, 2, 1, 0)}
    assert send((3, "b", 1, 1, 0, 1)) == {("b", 1, 1, 0, 1)}
    assert send((2, "c", 1, 1, 0, 0)) == {("b", 1, -2, 0, -2), ("b", 17, 2, 0, 2), ("c", 1, 1, 0, 0)}
    assert state[["least", "part", "n"]].values.tolist() == [[2, "c", 1]]
