"""The ten operators against brute force, libraries or round trips, and on awkward rows."""

import base64
import collections
import gzip
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import DATA, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterweir.llm import bpe, chat, exact, langid, linededup, minhash, packing, queries, shared, urlfilter, vectors, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wort " * 60_000
AWKWARD = [
    (1, "Ein Haus am See.\nZeile zwei", "de", "a", 27),
    (2, None, None, None, None),
    (3, "", "de", "a", 0),
    (4, "EIN HAUS AM SEE.\nZeile zwei", "de", "b", 27),
    (5, "123 !!! \t\n  ", "en", "b", 12),
    (6, LONG, "en", "a", len(LONG)),
    (7, "😀 it's we'll\u00a0ÄÖ\r\n\r\nend  ", None, "c", 10),
    (7, "😀 it's we'll\u00a0ÄÖ\r\n\r\nend  ", None, "c", 10),
    (None, "no id", "en", None, 5),
]


def awkward(spark):
    """Awkward documents with extra columns whose names clash with those of results."""
    clash = {c: F.lit("x") for c in ("ids", "offsets", "decoded", "lang_pred", "score", "lines_dropped", "keep_id", "class_id", "kept", "piece", "bucket", "key", "head", "words", "rep", "host", "line")}
    return spark.createDataFrame(AWKWARD, DOCS).withColumns(clash)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- 1 language ID ------------------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = got.join(truth, "doc_id").where("held_out AND lang IS NOT NULL").toPandas()
    assert len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert held["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark):
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    out = langid.predict(awkward(spark), model)
    assert len(out.columns) == len(set(out.columns)) == 6 + 17
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[2] == got[3] == got[5] == ("und", 0.0)
    assert got[1][0] == "de" and got[4] == got[1]
    assert langid.predict(empty(spark), model).count() == 0
    none = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.predict(awkward(spark), none).collect()} == {"und"}


def test_scores_equal_plain_naive_bayes(spark):
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    text = "Der Hund und die Katze"
    flat = langid.ngram_buckets(langid._codes(text))
    z = model.prior + model.logp[flat].astype(float).sum(axis=0)
    best, score, own = langid.score_texts(model, [text])
    assert best[0] == model.languages[int(z.argmax())] and score[0] == pytest.approx(1 / np.exp(z - z.max()).sum())
    assert own[0] == pytest.approx(model.logp[flat, int(z.argmax())].astype(float).mean() + np.log(1 << langid.BUCKET_BITS), abs=1e-5)


def fitted_by_hand(rows, alpha=0.5):
    """Languages, log priors and log probabilities by plain counting of n-grams."""
    languages = sorted({lang for _, lang in rows})
    n, counts = collections.Counter(lang for _, lang in rows), np.zeros((1 << langid.BUCKET_BITS, len(languages)))
    for text, lang in rows:
        for b in langid.ngram_buckets(langid._codes(text)):
            counts[b, languages.index(lang)] += 1
    return languages, np.log([n[x] / len(rows) for x in languages]), np.log((counts + alpha) / (counts + alpha).sum(axis=0))


def test_fit_equals_plain_counts(spark):
    rows = [(t, lang) for _, t, lang, *_ in AWKWARD if t is not None and lang is not None and t is not LONG] + [("ein Hund", "de"), ("a dog", "en"), ("a dog", "en")]
    frame = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([*rows, (None, "fr"), ("x", None)])], "doc_id long, text string, lang string").repartition(4)
    model, (languages, prior, logp) = langid.fit(frame), fitted_by_hand(rows)
    assert model.languages == languages and np.allclose(model.prior, prior) and np.allclose(model.logp, logp, atol=1e-5)


def test_bounds_of_the_training_sample(spark):
    same = spark.createDataFrame([(1, "gleich", "de")] * 50, "doc_id long, text string, lang string")
    many = spark.range(200).select("id", F.concat(F.lit("wort "), "id").alias("text"), F.concat(F.lit("l"), F.col("id") % 40).alias("lang")).toDF("doc_id", "text", "lang")
    seen = []
    original, langid.written = langid.written, lambda df, name: seen.append(out := original(df, name)) or out
    try:
        assert langid.fit(same, max_train=20).languages == ["de"]  # equal rows straddle the bound: as many as fit
        assert len(langid.fit(many, max_train=150, max_languages=7).languages) == 7
    finally:
        langid.written = original
    assert not any(spark._jvm.java.io.File(t.written_to[7:]).exists() for t in seen)


def test_language_query_equals_plain_naive_bayes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    part = np.array([zlib.crc32(str(d).encode()) % 3 for d in docs["doc_id"]])
    train = docs[(part != 1) & docs["text"].notna() & docs["lang"].notna()]
    languages, prior, logp = fitted_by_hand(list(zip(train["text"], train["lang"], strict=True)))
    got = queries.op1_language_id(spark, DATA).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for doc, text, m in zip(docs["doc_id"], docs["text"], part, strict=True):
        codes = langid._codes(text or "")
        z = prior + logp[langid.ngram_buckets(codes)].sum(axis=0)
        r = got.loc[doc]
        assert r.held_out == (m == 1)
        if codes.any():
            assert r.lang_pred == languages[int(z.argmax())] and r.score == pytest.approx(1 / np.exp(z - z.max()).sum(), abs=1e-3)
        else:
            assert (r.lang_pred, r.score) == ("und", 0)


# ---- 2 byte-level BPE ---------------------------------------------------------------------------------------------------

tiktoken = pytest.importorskip("tiktoken")
regex = pytest.importorskip("regex")
tokens = pytest.importorskip("public_tokenizers")
PATH = queries.vocabulary("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@given(st.text(st.sampled_from("a'strevlmdLE \n\té1!.x 😀\u3000²Ⅷ\u0301"), max_size=60))
@settings(max_examples=400, deadline=None)
def test_boundaries_equal_the_pattern(text):
    assert bpe.pre_tokens(text) == regex.findall(tokens.PATTERN, text)


def library_kinds():
    """Code point -> a plain stand-in of the class that the library's own pattern engine gives it."""
    one, out = {bytes([i]): i for i in range(256)}, {}
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    for pattern, stand in ((r"[^\s\p{L}\p{N}]", "!"), (r"\p{L}", "b"), (r"\p{N}", "2"), (r"\s", "\t")):
        ask = tiktoken.Encoding("ask", pat_str=pattern, mergeable_ranks=one, special_tokens={})
        for i in range(0, len(every), 50_000):
            out.update(dict.fromkeys(map(ord, bytes(ask.encode_ordinary("".join(every[i : i + 50_000]))).decode()), stand))
    assert len(out) == len(every)
    return out


def test_every_code_point_is_cut_as_by_the_library():
    """Beside a letter, a digit, a sign and a space; the pattern knows characters over 127 by their class alone."""
    kinds, points, bad = library_kinds(), [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF], []
    for i in range(0, len(points), 50_000):
        for form in ("{0}a", "{0}1", "{0}!", "a{0}", "1{0}", "!{0}", " {0}"):
            text = "\n".join(form.format(chr(c)) for c in points[i : i + 50_000])
            if bpe.token_starts(text)[0].tolist() != [m.start() for m in regex.finditer(tokens.PATTERN, text.translate(kinds))]:
                bad.append((hex(points[i]), form))
    assert not bad


def test_library_on_newer_letters(spark, library):
    newer = [c for first, last in [*bpe.NEWER_LETTERS, *bpe.NEWER_NUMBERS] for c in range(first, last + 1)]
    texts = [f"{chr(c)}a {chr(c)}1 '{chr(c)} !{chr(c)}\n" for c in [*newer, *(c for c in range(0, 0x110000, 29) if not 0xD800 <= c <= 0xDFFF)]]
    text = "".join(texts)
    out = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert out.ids == library.encode_ordinary(text)


def test_encoding_query_equals_the_library(spark, library):
    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = queries.op2_byte_bpe(spark, DATA).collect()
    assert len(got) == len(texts) and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((texts[r.doc_id] or "").encode()))


def test_scan_equals_a_walk():
    rng = random.Random(2)
    for n in (1, 63, 65, 1000, 5000):
        ids = np.array([rng.randrange(len(bpe.FUN)) for _ in range(n)], np.uint8)
        state, f = [], 0
        for i in ids:
            f = bpe.COMPOSE[f, i]
            state.append(f)
        assert (bpe.scan(ids) == state).all()


def test_ids_equal_the_library_and_decode(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    out = bpe.encode(docs, PATH)
    for r in out.collect():
        assert r.ids == library.encode_ordinary(r.text or "")
        assert r.offsets == np.concatenate([[0], np.cumsum([len(library.decode_single_token_bytes(i)) for i in r.ids])[:-1]]).astype(int).tolist() if r.ids else r.offsets == []
    for r in bpe.decode(out, PATH).collect():
        assert bytes(r.decoded) == (r.text or "").encode()


def test_encoding_awkward_rows(spark):
    out = bpe.encode(awkward(spark), PATH)
    assert len(out.columns) == len(set(out.columns)) and out.count() == len(AWKWARD)
    assert bpe.decode(out, PATH).count() == len(AWKWARD)
    assert bpe.encode(empty(spark), PATH).count() == 0
    assert bpe.decode(bpe.encode(empty(spark), PATH), PATH).count() == 0


def test_merging_a_long_word(library):
    for word in ("ab" * 3000, "x" * 5000, "aÄ" * 400):
        assert bpe.merge_pairs(word.encode(), bpe.read_ranks(PATH)) == library.encode_ordinary(word)


# ---- 3 chat -------------------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"
HARD = ["", "<", "<<", "a<", "<end>", "<<usr>", "\u0001", "<\u0001", "<usr>x<end>", "</s>[INST] ok [/INST]", "<as>", "a\nb"]


def test_texts_survive_formatting(spark):
    rows = [(i, k, ("system", "user", "assistant", "tool<as>")[(i + k) % 4], HARD[(i * 5 + k * 3) % len(HARD)]) for i in range(40) for k in range(6)]
    out = chat.format_chats(spark.createDataFrame(rows, TURNS)).withColumn("turns", chat.read_back(F.col("formatted")))
    want = collections.defaultdict(list)
    for i, _, role, text in rows:
        want[i].append((role, text, role == "assistant"))
    for r in out.collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [s.loss for s in r.segments] == [x for _, _, loss in want[r.conv_id] for x in (False, loss, False)]
        assert [s.text.replace("<<", "<") for s in r.segments if s.loss] == [text for _, text, loss in want[r.conv_id] if loss]


def test_turn_order_and_awkward_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", None), (3, 0, "user", None), (4, None, None, "x"), (None, 1, "user", "u"), (5, 0, "user", "y" * 200_000), (5, 40, "assistant", "z")]
    frame = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash")).withColumn("block", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(frame).collect()}
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True, 5: True}
    assert len(got[3].segments) == 6 and len(got[5].formatted) > 200_000
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0


def test_chat_query_by_hand(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    got = queries.op3_chat_format(spark, DATA).toPandas().set_index("conv_id")
    for conv, own in rows.groupby("conv_id"):
        whole = "".join(f"{r}\n{t or ''}\n" for r, t in zip(own["role"], own["text"], strict=True))
        learnt = "".join(own["text"][own["role"] == "assistant"])
        r = got.loc[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert got.loc[-1].loss_chars == len(queries.INJECTED) and got.loc[-1].n_turns == 2


# ---- 4 packing ----------------------------------------------------------------------------------------------------------

JSON = queries.vocabulary("byte_bpe_50k.json")


def full(out, limit=2048):
    """Sequences without gaps or overlaps; documents whole."""
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        ends = own["offset"] + own["length"]
        assert own["offset"].iloc[0] == 0 and (own["offset"].to_numpy()[1:] == ends.to_numpy()[:-1]).all() and ends.iloc[-1] <= limit


def test_packing_whole_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.op4_best_fit_packing(spark, DATA).toPandas()
    full(out)
    texts = dict(docs.select("doc_id", "text").collect())
    for doc, own in out.groupby("doc_id"):
        ids = np.array([*t.encode(texts[doc], add_special_tokens=False).ids, 0], "<u4")
        own = own.sort_values("piece")
        assert own["piece"].tolist() == list(range(len(own))) and own["length"].sum() == len(ids)
        assert (own["length"].iloc[1:] == 2048).all() and len(own) == -(-len(ids) // 2048)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()
    assert out["sequence_id"].nunique() <= 1.02 * out["length"].sum() / 2048 + 1


def test_packing_texts_with_added_tokens(spark):
    from tokenizers import Tokenizer

    t, end = Tokenizer.from_file(JSON), "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end}", f"one  {end}  two\n{end}", f"it{end}'s", "<|endoftext", f"<|endoftext{end}|>", "plain  text ", "", LONG + end + LONG]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.json_encoder(JSON).encode_all(texts)] == want
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON).toPandas()
    full(out)
    for doc, own in out.groupby("doc_id"):
        ids = np.array([*want[doc], 0], "<u4")
        assert own["length"].sum() == len(ids)
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"], strict=True)] == own["ids_crc32"].tolist()


def test_all_capacities_hold():
    rng = np.random.default_rng(0)
    n = np.sort(rng.integers(1, 400, 900))[::-1]
    for rule in ("residual", "dot"):
        cap = packing.Capacity(500, 5, 120_000.0, (1.0, 0.5, 0.5), rule)
        n_own = n[n.astype(float) ** 2 <= cap.attention]
        bins, at = packing.fit_bins(n_own, cap)
        p = pd.DataFrame({"bin": bins, "n": n_own, "sq": n_own.astype(float) ** 2, "offset": at}).groupby("bin")
        assert p["n"].sum().max() <= 500 and p["n"].count().max() <= 5 and p["sq"].sum().max() <= 120_000
    with pytest.raises(ValueError, match="over a capacity"):
        packing.fit_bins(np.array([600]), packing.Capacity(500, 5))


def test_packing_awkward_rows(spark):
    out = packing.pack(awkward(spark), JSON).toPandas()
    full(out)
    assert (out["doc_id"] == 7).sum() == 2 and out[out["doc_id"] == 2]["length"].tolist() == [1] and out["doc_id"].isna().sum() == 1
    assert packing.pack(empty(spark), JSON).count() == 0
    few = packing.pack(awkward(spark), JSON, packing.Capacity(64, 3, 64.0**2), group_pieces=4).toPandas()
    full(few, 64)
    assert few.groupby("sequence_id")["length"].count().max() <= 3


# ---- 5 exact dedup ------------------------------------------------------------------------------------------------------


def by_hand(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups["".join(c.lower() if c.isascii() else c for c in text or "")].append(doc)
    out = []
    for doc, text in rows:
        body = "".join(c.lower() if c.isascii() else c for c in text or "")
        ids = [d for d in groups[body] if d is not None]
        keep = max(ids) if ids else None
        out.append((doc, len(groups[body]), doc == keep, keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [600, 16 << 20])
def test_exact_groups_by_hand(spark, bucket_bytes):
    extra = [(100 + i, f"text {i % 40}" if i % 3 else "Hot TEXT ä Ä") for i in range(300)]
    rows = [(r[0], r[1]) for r in AWKWARD] + extra
    frame = awkward(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True).repartition(5)
    got = exact.exact_groups(frame, bucket_bytes=bucket_bytes).collect()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("hash_index")]
    assert sorted(((r.doc_id, r.group_size, r.kept, r.keep_id, r.text_sha256) for r in got), key=str) == by_hand(rows)
    assert exact.exact_groups(empty(spark)).count() == 0


def test_buckets_share_files(spark, monkeypatch):
    """Many buckets don't make as many files, and the groups are the same; few buckets have a file each."""
    made, original = [], exact.new_path
    monkeypatch.setattr(exact, "new_path", lambda *a: made.append(original(*a)) or made[-1])
    rows = [(i, f"text number {i % 1500}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact.exact_groups(frame, bucket_bytes=2_000).collect()
    assert sorted(((r.doc_id, r.group_size, r.kept, r.keep_id, r.text_sha256) for r in got), key=str) == by_hand(rows)
    index = spark.read.parquet(made[-1])
    buckets, files = index.where("bucket >= 0").select("bucket").distinct().count(), index.select(F.input_file_name()).distinct().count()
    assert buckets > 500 and files < buckets / 2  # empty buckets have their share of the files, too
    assert exact.index_files(1, 8) == 1 and exact.index_files(12, 8) == 12 and exact.index_files(10**9, 8) == exact.MOST_FILES


def test_directory_splits_overfull_buckets():
    counts = np.zeros(64, np.int64)
    counts[:4], counts[40] = 10, 3
    entry, depth = exact.directory(counts, 12)
    assert len(entry) == 1 << depth and (np.diff(entry) >= 0).all()
    wide = np.repeat(entry, 64 >> depth)
    assert max(counts[wide == b].sum() for b in np.unique(entry)) <= 12
    assert exact.directory(np.array([5]), 10)[1] == 0


# ---- 6 near dedup -------------------------------------------------------------------------------------------------------


def bag(text, k=5):
    w = (text or "").lower().split()
    k = min(k, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else collections.Counter()


def classes(rows):
    bags, parent = {d: bag(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(bags, 2):
        if bags[a] and bags[b] and sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in bags}


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"neu{rng.random():.6f}"
    return " ".join(words)


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(25):
        base = [f"w{rng.randrange(900)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 2, 6, 20])):
            rows.append((n, edited(rng, base, min(len(base), rng.choice([0, 1, 2, 3, 5])))))
            n += 1
        base = base[:4] * 12
        rows += [(n, " ".join(base)), (n + 1, " ".join(base[:-1]))]
        n += 2
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, LONG), (n + 4, LONG + " ende")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).withColumn("class_id", F.lit("x")).repartition(6)
    for params in (minhash.NearParams(), minhash.NearParams(block=3)):
        got = {r.doc_id: r.class_id for r in minhash.near_groups(frame, params).collect()}
        assert got == classes(rows)


def template_pages(n, seed=3):
    """Pages of a shared template and words of their own, at a similarity of about 0.7; a few pairs are near copies."""
    rng = random.Random(seed)
    head = [f"vorlage{k}" for k in range(150)]
    rows = []
    for i in range(n):
        own = [f"eigen{i}x{k}" for k in range(22)]
        rows.append((i, " ".join(head[:75] + own + head[75:])))
    for k in range(0, n // 50):
        own = [f"eigen{k}x{j}" for j in range(22)]
        own[rng.randrange(22)] = "anders"
        rows.append((n + k, " ".join(head[:75] + own + head[75:])))
    return rows


def test_pages_of_a_template_are_no_pairs(spark, monkeypatch):
    """Work on pages that share a template grows with their number, not with its square; near copies among them are found."""
    seen = {}
    original = minhash.written

    def counted(df, name):
        out = original(df, name)
        seen[name] = seen.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(minhash, "written", counted)
    made = []
    for n in (500, 2000):
        seen.clear()
        rows = template_pages(n)
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
        got = {r.doc_id: r.class_id for r in minhash.near_groups(frame).collect()}
        assert got == {i: i - n if i >= n else i for i, _ in rows}
        assert "crowd" in seen and seen["crowd"] > n / 4
        made.append(seen.get("prefixes-met", 0) + seen.get("prefix-pairs", 0) + seen.get("pairs", 0))
    assert made[1] <= 4**1.3 * max(made[0], 20)


@pytest.mark.parametrize("outsiders", [0, 10**9])
def test_crowded_buckets_equal_brute_force(spark, outsiders):
    """All open buckets by rare shingles, or none of them: the same classes."""
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.choice([30, 90]))] + [f"alle{k}" for k in range(60)]
        for _ in range(12):
            rows.append((len(rows), edited(rng, base, rng.choice([1, 3, 6, 9]))))
        rows.append((len(rows), " ".join(base[:5] * 20)))
        rows.append((len(rows), " ".join(base[:5] * 19)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.near_groups(frame, minhash.NearParams(outsiders=outsiders)).collect()}
    assert got == classes(rows)


@pytest.mark.parametrize("seed", range(5))
def test_prefixes_of_links_meet(seed):
    """Any two sets at the similarity share an element of both prefixes within both caps."""
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 50, 1 << minhash.COUNTER_BITS)
    for _ in range(300):
        n, own, other = rng.integers(1, 60), rng.integers(0, 8), rng.integers(0, 8)
        a, b, c = (rng.integers(0, 1 << 62, k).astype(np.uint64) for k in (n, own, other))
        x, y = np.concatenate([a, b]), np.concatenate([a, c])
        if n / (n + own + other) < 0.8:
            continue
        (p, cap_p), (q, cap_q) = (minhash._prefix(v, counts, 0.8) for v in (x, y))
        caps = dict(zip(q.tolist(), cap_q.tolist(), strict=True))
        assert any(e in caps and len(y) <= c and len(x) <= caps[e] for e, c in zip(p.tolist(), cap_p.tolist(), strict=True))


def test_string_ids(spark):
    rows = [("urn:b", "ein kleiner text mit sieben ganzen worten hier"), ("urn:a", "ein kleiner text mit sieben ganzen worten hier"), ("urn:c", "etwas anderes steht hier ganz allein"), (None, "x")]
    got = {r.doc_id: (r.class_id, r.kept) for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"urn:b": ("urn:a", False), "urn:a": ("urn:a", True), "urn:c": ("urn:c", True), None: (None, True)}
    vecs = spark.createDataFrame([("b", [1.0, 2.0], "x"), ("a", [1.0, 2.01], "x"), ("c", [1.0, 2.0], "y")], "vec_id string, embedding array<double>, label string")
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(vecs).collect()} == {"b": (1, "a"), "a": (1, "a"), "c": (0, "c")}


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    u = np.sort(rng.choice(2**62, 300, replace=False).astype(np.uint64))
    a, b = rng.integers(1, 20, 300), rng.integers(1, 20, 300)
    sig = minhash.signatures([(u, a), (u, b), (u[:1], a[:1])], 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5
    assert minhash.weighted_jaccard((u, a), (u, b)) == pytest.approx(true)
    again = minhash.signatures([(u, b)], 4096)
    assert (again[0] == sig[1]).all()


def links_by_prefix(rows, least=0.8, k=5):
    """All links of ``(id, text)`` rows: of two texts that are similar enough, rare shingles of one are among the rare ones of the other."""
    bags = [(d, bag(t, k)) for d, t in rows]
    order = collections.Counter(x for _, b in bags for x in b)
    index, out = collections.defaultdict(list), []
    for i, (d, b) in enumerate(bags):
        if not b:
            continue
        whole, seen = sum(b.values()), set()
        tokens_ = sorted(((order[x], x, n) for n_x, x in ((b[x], x) for x in b) for n in range(n_x)), key=lambda t: (t[0], t[1], t[2]))
        for _, x, n in tokens_[: whole - int(np.ceil(least * whole - 1e-9)) + 1]:
            for j in index[x, n]:
                if j not in seen:
                    seen.add(j)
                    other = bags[j][1]
                    both = sum((b & other).values())
                    if both >= least * (whole + sum(other.values()) - both) - 1e-9:
                        out.append((d, bags[j][0]))
            index[x, n].append(i)
    return out


def roots(ids, links):
    parent = {d: d for d in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_query_equals_an_exact_join(spark):
    where = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text").collect()]
    links = links_by_prefix(rows)
    assert len(links) > 50 and classes(rows[:120]) == roots([d for d, _ in rows[:120]], links_by_prefix(rows[:120]))
    got = {r.doc_id: r.class_id for r in queries.op6_minhash_near_dedup(spark, where).collect()}
    assert got == roots([d for d, _ in rows], links)


def test_near_groups_of_repeated_ids(spark):
    rng = random.Random(6)
    a, b, c = ([f"w{rng.randrange(9000)}" for _ in range(60)] for _ in range(3))
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, " ".join([*a, "x"])), (9, " ".join([*b, "y"])), (3, " ".join([*c, "z"])), (4, " ".join(c)), (5, " ".join(c)), (5, None)]
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == [(3, 3), (4, 3), (5, 3), (5, 5), (7, 7), (7, 7), (8, 7), (9, 7)]


def test_near_groups_of_awkward_rows(spark):
    got = collections.defaultdict(set)
    for r in minhash.near_groups(awkward(spark)).collect():
        got[r.doc_id].add((r.class_id, r.kept))
    assert got[1] == {(1, True)} and got[4] == {(1, False)} and got[2] == {(2, True)} and got[3] == {(3, True)} and got[7] == {(7, True)}
    assert got[None] == {(None, True)}
    assert minhash.near_groups(empty(spark)).count() == 0
    kept = minhash.keep_one(awkward(spark))
    assert kept.columns == awkward(spark).columns and kept.count() == len(AWKWARD) - 1


# ---- 7 WARC -------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"
SITES = [(3, "http://a.org/x", "<p>same</p>"), (1, "http://b.org/\r\ny", "<p>same</p>"), (2, None, None), (5, "http://c.org", ""), (4, "http://d.org", "ä" * 300_000), (4, "http://d.org", "twin"), (6, "http://WARC/1.1", "\r\n\r\nWARC/1.1\r\nWARC-Type: x\r\n\r\n")]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(SITES, PAGES).withColumn("payload", F.lit(1)).withColumn("first", F.lit(2)).repartition(3)
    path = warc.write_archive(pages, f"file://{tmp_path}/w")
    got = {(r.page_id, r.payload_digest): r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(SITES)
    for page, _, html in SITES:
        data = (html or "").encode()
        r = got[page, warc.base32_sha1(data)]
        assert r.payload_bytes == len(data)
        if page in (3, 5):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", {3: 1, 5: 2}[page], None)
        else:
            assert r.record_type == "response" and bytes(r.payload) == data
    first = got[1, warc.base32_sha1(b"<p>same</p>")]
    assert first.target_uri == "http://b.org/%0D%0Ay" and got[3, first.payload_digest].refers_to_uri == first.target_uri
    assert len({r.record_id for r in got.values()}) == len(SITES) and all(r.date.endswith("Z") for r in got.values())


def test_compressed_archive_equals_the_plain_one(spark, tmp_path):
    pages = spark.createDataFrame([*SITES, (None, "u", "<p>same</p>")], PAGES).withColumn("sha", F.lit("clash"))
    rows = []
    for name, options in (("a", {}), ("b", {"compression": "gzip", "date": "2020-01-02T03:04:05Z"})):
        path = warc.write_archive(pages, f"file://{tmp_path}/{name}", **options)
        found = warc.read_archive(spark, path)
        rows.append(sorted((str((r.page_id, r.record_type, r.target_uri, r.payload_digest, r.payload_bytes, r.refers_to)), bytes(r.payload or b"")) for r in found.collect()))
    assert rows[0] == rows[1] and {r.date for r in found.collect()} == {"2020-01-02T03:04:05Z"}
    assert [n for n in (tmp_path / "b").iterdir() if n.name.endswith(".warc.gz")]
    assert found.where("page_id IS NULL").first().record_type == "response"


FOREIGN = (
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Type: application/warc-fields\r\nContent-Length: 14\r\n\r\nsoftware: x/1\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://a.org/\r\nContent-Type: application/http; msgtype=request\r\nContent-Length: 18\r\n\r\nGET / HTTP/1.1\r\n\r\n\r\n\r\n"
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Target-URI: http://a.org/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 80\r\n\r\n"
    b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5;x=y\r\nhello\r\n6\r\n world\r\n0\r\n\r\n\r\n\r\n"
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Target-URI: file://b\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nplain\r\n\r\n"
)


def test_archives_from_elsewhere(spark, tmp_path):
    import gzip

    records = [b"WARC/1.0" + r for r in FOREIGN.split(b"WARC/1.0")[1:]]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "x.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    (tmp_path / "y.warc").write_bytes(FOREIGN)
    (tmp_path / "notes.txt").write_text("x")
    for path, times in ((f"file://{tmp_path}", 2), (f"file://{tmp_path}/y.warc", 1), (f"{tmp_path}/deep/x.warc.gz", 1)):
        got = warc.read_archive(spark, path)
        assert sorted((r.record_type, r.record_id, r.payload and bytes(r.payload)) for r in got.collect()) == sorted([("warcinfo", "urn:uuid:1", None), ("request", "urn:uuid:2", None), ("response", "urn:uuid:3", b"hello world"), ("resource", "urn:uuid:4", b"plain")] * times, key=str)
        assert got.where("record_type = 'response'").count() == times
        assert got.where("target_uri = 'file://b'").first().payload_bytes == 5


def test_archive_query_by_hand(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet").toPandas()
    digest = {p: warc.base32_sha1((h or "").encode()) for p, h in zip(pages["page_id"], pages["html"], strict=True)}
    first = {}
    for p in sorted(digest):
        first.setdefault(digest[p], p)
    got = queries.op7_warc(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        again = first[digest[r.page_id]] != r.page_id
        assert (r.payload_digest, r.record_type, r.refers_to) == (digest[r.page_id], "revisit" if again else "response", first[digest[r.page_id]] if again else None)


def test_commits_to_one_folder_add_up(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"text {i}") for i in range(6)], "page_id long, url string, html string")
    path = f"{tmp_path}/archive"
    warc.write_archive(pages.where("page_id < 2"), path)
    warc.write_archive(pages.where("page_id >= 2 AND page_id < 4"), path, compression="gzip")
    assert sorted(r.page_id for r in warc.read_archive(spark, path).collect()) == [0, 1, 2, 3]
    warc.register(spark)
    rows, first = warc.archive_rows(pages.where("page_id >= 4"))
    rows.write.format("warc").mode("overwrite").save(path)
    assert sorted(r.page_id for r in warc.read_archive(spark, path).collect()) == [4, 5]
    shared.discard(first)


def test_broken_payloads_and_files_keep_the_rest(spark, tmp_path):
    """Payloads that don't decode are null with a reason; a file that breaks off, or isn't WARC, says so in a row of its own."""

    def record(uri, body, encoding=b"gzip"):
        block = b"HTTP/1.1 200 OK\r\nContent-Encoding: " + encoding + b"\r\n\r\n" + body
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: <" + uri + b">\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    good = record(b"http://good/", gzip.compress(b"fine"))
    bad = [record(b"http://bad/1", b"no gzip"), record(b"http://bad/2", gzip.compress(b"x" * 99)[:-9]), record(b"http://bad/3", b"no zlib", b"deflate")]
    (tmp_path / "a.warc").write_bytes(good + b"".join(bad) + good)
    (tmp_path / "b.warc").write_bytes(good + good[:-30])
    (tmp_path / "c.warc").write_bytes(b"<html>not an archive</html>\r\n\r\n")
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good)[:-12])
    got = warc.read_archive(spark, str(tmp_path)).collect()
    assert [bytes(r.payload) for r in got if r.target_uri == "http://good/"] == [b"fine"] * 4
    assert sorted((r.target_uri, r.payload, bool(r.problem)) for r in got if "bad" in (r.target_uri or "")) == [(f"http://bad/{i}", None, True) for i in (1, 2, 3)]
    assert len([r for r in got if r.record_type == "broken" and r.problem]) == 3 and all(r.problem is None for r in got if r.payload is not None)
    found = warc.read_archive(spark, str(tmp_path / "a.warc")).where("target_uri = 'http://bad/2'").collect()
    assert [r.target_uri for r in found] == ["http://bad/2"]
    with pytest.raises(Exception, match="gzip"):
        spark.read.format("warc").option("strict", "true").load(str(tmp_path / "a.warc")).collect()


def test_predicates_reach_the_reader(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame(SITES, PAGES), f"file://{tmp_path}/w")
    some = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    assert sorted(r.page_id for r in some.collect()) == [3, 5]
    one = warc.read_archive(spark, path).where("target_uri = 'http://a.org/x'")
    assert one.count() == 1 and " Filter " not in one._jdf.queryExecution().executedPlan().toString()
    assert all(r.payload is None for r in warc.read_archive(spark, path, payload=False).collect())


def test_skipped_payloads_are_not_decoded(tmp_path):
    import io

    from pyarrow import BufferReader

    rows = [{"record_type": "response", "page_id": i, "payload_digest": "D", "payload_bytes": 3, "target_uri": "u", "refers_to": None, "payload": b"abc"} for i in range(3)]
    raw = b"".join(warc.record_bytes(r, str(i), "2020-01-01T00:00:00Z") for i, r in enumerate(rows)).replace(b"\x1f\x8b", b"\0\0")  # no payload can be decoded any more
    assert len(list(warc.parse(BufferReader(raw), {"response"}, {}, payload=False))) == 3
    assert list(warc.parse(BufferReader(raw), {"revisit"}, {}, payload=True)) == []
    with pytest.raises(OSError, match="gzip"):
        list(warc.parse(BufferReader(raw), None, {}, payload=True))
    assert io.BytesIO(raw).read(8) == warc.VERSION


def test_empty_archive_and_digest(spark, tmp_path):
    path = warc.write_archive(spark.createDataFrame([], PAGES), f"file://{tmp_path}/w")
    assert warc.read_archive(spark, path).count() == 0
    for text in ("", "abc", "ä" * 99):
        got = spark.range(1).select(warc.sha1_base32(F.sha1(F.lit(text)))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


# ---- 8 URL filter -------------------------------------------------------------------------------------------------------


def judged_by_hand(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min((i for i in (path.find(c) for c in "?#") if i >= 0), default=len(path))]
    fit = [(len(k), v == "block", k, v) for k, v in rules if host and (host == k[: k.index("/")] or host.endswith("." + k[: k.index("/")])) and path.startswith(k[k.index("/") :])]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


URLS = ["http://A.example.ORG/es/1?x#y", "https://example.org/en/12", "https://xample.org/en/12", "http://org/", "http://org", "http://b.org?/es/", "x", None, "", "://", "http://a://b/c", "http://fr.com/fr/x", "http://fr.com/de/x#/fr/", "http://notcom/fr/", "ftp://u.com/fr/\nde", "http://com./fr/", "http://Ä.com/de/"]


def test_urls_by_hand(spark):
    rules = [*queries.RULES, *[(f"h{i}.net/p{i % 7}", "block") for i in range(60)]]
    urls = URLS + [f"http://s.h{i}.net/p{j}" for i in range(70) for j in range(9)]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(frame, rules).collect()}
    assert got == {i: judged_by_hand(u, rules) for i, u in enumerate(urls)}


def test_long_lists_and_awkward_urls(spark):
    """Lists cut into several cascades; repeated rows and a very long URL."""
    rules = [*queries.RULES, *[(f"h{i}.net/p{i % 7}", ("block", "allow")[i % 2]) for i in range(300)], ("h4.net/p4", "allow")]
    urls = [*URLS, *[f"http://s.h{i % 310}.net/p{i % 9}" for i in range(900)], "http://a.example.org/es/" + "x" * 300_000]
    rows = [(i, u) for i, u in enumerate(urls)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(frame, spark.createDataFrame(rules, "key string, verdict string"), max_bytes=100).collect()]
    assert sorted(got, key=str) == sorted([(i, *judged_by_hand(u, rules)) for i, u in rows], key=str)
    assert urlfilter.judge(frame.limit(0), rules, max_bytes=100).count() == 0


def test_cascade_is_exact(spark):
    universe = spark.range(3000).select(F.col("id").cast("string").alias("key"))
    listed = universe.where("cast(key as int) % 7 = 0").union(spark.createDataFrame([("elsewhere",), (None,)], "key string"))
    made = urlfilter.build(listed, universe)
    assert 1 < len(made.levels) < 12
    at = universe.select("key", *[urlfilter._positions(F.col("key"), k, bits, hashes).alias(f"l{k}") for k, (bits, hashes, _) in enumerate(made.levels)]).toPandas()
    got = made.contains([np.stack(at[f"l{k}"].to_numpy()) for k in range(len(made.levels))])
    assert (got == (at["key"].astype(int) % 7 == 0)).all()
    assert urlfilter.build(listed.limit(0), universe).levels == []


def test_levels_follow_the_list_not_the_universe(spark):
    """A short list in a large universe: all levels stay small, and the answer is exact."""
    universe = spark.range(200_001).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net/")).alias("key"))
    listed = universe.where("key IN ('h7.net/', 'h1234.net/')")
    made = urlfilter.build(listed, universe)
    assert all(len(data) <= 1 << 17 and len(data) == bits // 8 for bits, _, data in made.levels)
    assert sum(len(data) for _, _, data in made.levels[1:]) <= 64
    pages = universe.select(F.monotonically_increasing_id().alias("page_id"), F.concat(F.lit("http://"), "key").alias("url"))
    judged = urlfilter.judge(pages, [("h7.net/", "block"), ("h1234.net/", "allow"), ("net/", "allow")])
    assert sorted((r.host, r.rule) for r in judged.where("rule <> 'net/' OR rule IS NULL").collect()) == [("h1234.net", "h1234.net/"), ("h7.net", "h7.net/")]


def test_levels_of_a_long_list_keep_their_bound(spark, monkeypatch):
    seen, original = [], urlfilter._level
    monkeypatch.setattr(urlfilter, "_level", lambda *a: seen.append(original(*a)) or seen[-1])
    rules = spark.range(4000).select(F.concat(F.lit("s"), F.col("id"), F.lit(".net/")).alias("key"), F.when(F.col("id") % 9 == 0, "allow").otherwise("block").alias("verdict"))
    pages = spark.range(60_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://s"), F.col("id"), F.lit(".net/x")).alias("url"))
    monkeypatch.setattr(urlfilter, "LEAST_BITS", 64)
    got = urlfilter.judge(pages, rules, max_bytes=4096)
    assert got.where("verdict = 'block'").count() == 4000 - 445 and got.where("rule IS NOT NULL").count() == 4000
    assert max(len(x[2]) for x in seen if x) <= 4096 and len([x for x in seen if x]) > 8


@pytest.mark.parametrize("rule", [("example.org", "block"), ("example.org/", "deny"), ("example.org/", None)])
def test_odd_rules_raise(spark, rule):
    with pytest.raises(ValueError, match="neither"):
        urlfilter.judge(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), spark.createDataFrame([rule], "key string, verdict string"))


def test_no_rules_and_no_pages(spark):
    frame = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert urlfilter.judge(frame, [], default="block").first().verdict == "block"
    assert urlfilter.judge(frame.limit(0), queries.RULES).count() == 0


# ---- 9 line dedup -------------------------------------------------------------------------------------------------------


def cleaned(rows, ratio, distinct, fellows, least):
    total, pages = collections.Counter(), collections.Counter()
    for host, text in {(h or "", t) for _, h, t in rows} if distinct else [(h or "", t) for _, h, t in rows]:
        total[host] += 1
        for line in set((text or "").split("\n")) - {""}:
            pages[host, line] += 1
    bad = {k for k, n in pages.items() if n >= least and n - fellows > (total[k[0]] - fellows) * ratio}
    out = []
    for doc, host, text in rows:
        lines = None if text is None else text.split("\n")
        keep = None if lines is None else [x for x in lines if (host or "", x) not in bad]
        out.append((doc, None if keep is None else "\n".join(keep), 0 if keep is None else len(lines) - len(keep)))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [8 << 20, 0])
@pytest.mark.parametrize(("distinct", "fellows", "least"), [(False, False, 1), (True, True, 2), (True, False, 1), (False, True, 3)])
def test_lines_by_hand(spark, size, distinct, fellows, least):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), "\n".join(rng.choice(["menu", "Menu", "", "foot", *[f"line {k}" for k in range(60)]]) for _ in range(rng.randrange(6)))) for i in range(200)]
    rows += [(500, "a", None), (501, "a", "menu\nmenu\n\nmenu"), (502, "a", LONG), (503, "a", "menu"), (503, "a", "menu"), (504, "one", "alone\non its host")]
    rows += [(600 + i, "a", "copied\ntwice\n\ncopied") for i in range(40)] + [(700 + i, "a", None) for i in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("lines_dropped", F.lit("x")).withColumn("_bad", F.lit(1)).withColumn("line", F.lit(2)).withColumn("whole", F.lit(1)).withColumn("own", F.lit(2))
    out = linededup.drop_boilerplate(frame, max_ratio=0.05, broadcast_bytes=size, distinct=distinct, fellows=fellows, least_pages=least)
    want = cleaned(rows, 0.05, distinct, fellows, least)
    assert sorted(((r.doc_id, r.text, r.lines_dropped) for r in out.collect()), key=str) == want
    assert len(out.columns) == len(set(out.columns)) == 8
    assert (600, "copied\ntwice\n\ncopied", 0) in want if distinct else (600, "", 3) in want
    assert ((504, "alone\non its host", 0) in want) == fellows and any(n for _, _, n in want)


def test_the_repeated_line_goes_in_every_source(spark):
    line = "The and attion to thanedble the, anea. Eriner thanea."
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    has = F.array_contains(F.split("text", "\n", -1), line)
    assert docs.where(has).select("source").distinct().count() == 20
    for distinct in (False, True):
        assert linededup.drop_boilerplate(docs, distinct=distinct).where(has).count() == 0


def test_no_lines(spark):
    out = linededup.drop_boilerplate(empty(spark))
    assert out.count() == 0 and set(out.columns) == {*empty(spark).columns, "lines_dropped"}
    assert linededup.drop_boilerplate(awkward(spark)).count() == len(AWKWARD)


# ---- 10 embeddings ------------------------------------------------------------------------------------------------------


def links_by_hand(rows, least):
    out, parent = collections.Counter(), {v: v for v, _, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, x, k), (b, y, m) in itertools.combinations(rows, 2):
        if k is None or k != m or x is None or y is None or len(x) != len(y) or None in x or None in y:
            continue
        x, y = np.array(x, float), np.array(y, float)
        if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any() and (x @ y) / np.linalg.norm(x) / np.linalg.norm(y) >= least:
            out[a] += 1
            out[b] += 1
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    return {v: (out[v], find(v)) for v, _, _ in rows}


def test_vectors_by_hand(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        x = rng.normal(size=16) if i % 3 or i < 30 else np.array(rows[i - 3 * int(rng.integers(1, 9))][1]) + rng.normal(size=16) * 0.09
        rows.append((i, [float(np.float32(v)) for v in x], int(i % 3)))
    same = rows[0][1]
    rows += [(700 + i, same, 0) for i in range(50)]
    rows += [(800, None, 1), (801, [0.0] * 16, 1), (802, [float("nan")] + [1.0] * 15, 1), (803, [None] + [1.0] * 15, 1), (804, same, None), (805, [], 1), (806, [1.0, 2.0], 1), (807, [1e30, 2e30], 1), (808, [float("inf")] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("unit", F.lit(1)).withColumn("n_links", F.lit(0))
    rows = [(v, None if x is None else [None if e is None else float(np.float32(e)) for e in x], k) for v, x, k in rows]
    for params in (vectors.PQParams(), vectors.PQParams(list_size=20, probes=30, block=16, codes=8), vectors.PQParams(cell_rows=30, visits=40, block=20, list_size=5, probes=5)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame, params).collect()}
        assert got == links_by_hand(rows, 0.93)


def test_vectors_of_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    near = [v, v + 0.01, v + 0.02, 2 * v]
    rows = [(7, v), (7, -v), (5, near[1]), (6, near[2]), (6, near[3]), (8, -v), (9, -v), (None, v)]
    frame = spark.createDataFrame([(i, [float(x) for x in x], 1) for i, x in rows], "vec_id long, embedding array<double>, label int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(frame).collect()), key=str)
    assert got == sorted([(7, 3, 5, False), (7, 2, 7, True), (5, 3, 5, True), (6, 3, 5, False), (6, 3, 5, False), (8, 2, 7, False), (9, 2, 7, False), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("params", [vectors.PQParams(), vectors.PQParams(cell_rows=200, block=300), vectors.PQParams(cell_rows=40)])
def test_recall_with_few_probes(spark, tmp_path, params):
    """One label, planted pairs of cosine 0.93 to 0.97: 46 lists for 8 probes; 60 cells for 3 visits, in blocks; 300 cells for 3 visits."""
    rng, n, dim = np.random.default_rng(2), 12_000, 64
    x = rng.normal(size=(n, dim)) + rng.normal(size=dim) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(1, 4_000, 2):
        c, away = rng.uniform(0.932, 0.97), rng.normal(size=dim)
        away -= (away @ x[i - 1]) * x[i - 1]
        x[i] = c * x[i - 1] + (1 - c * c) ** 0.5 * away / np.linalg.norm(away)
    x = x.astype(np.float32)
    pd.DataFrame({"vec_id": np.arange(n), "embedding": list(x), "label": 1}).to_parquet(tmp_path / "e.parquet")
    frame = spark.read.parquet(f"{tmp_path}/e.parquet").repartition(5)
    got = vectors.near_vectors(frame, params).toPandas().set_index("vec_id").sort_index()
    e = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (e @ e.T >= 0.93).sum(axis=1) - 1
    assert len(got) == n and true.sum() >= 3_900 and (got["n_links"].to_numpy() <= true).all()
    print("recall", got["n_links"].sum() / true.sum())
    assert got["n_links"].sum() >= 0.9 * true.sum()


def test_vector_query_finds_planted_links(spark, tmp_path):
    """The query on the table with near copies of its own rows: links of 0.93 and more, by brute force."""
    pdf = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    rng = np.random.default_rng(5)
    more = pdf[pdf["label"].notna() & pdf["embedding"].notna()].head(120).copy()
    more["vec_id"] += 10**6
    more["embedding"] = [(np.asarray(v, np.float32) + rng.normal(size=len(v)).astype(np.float32) * np.float32(np.std(v) * s)) for v, s in zip(more["embedding"], rng.uniform(0.1, 0.5, len(more)), strict=True)]
    both = pd.concat([pdf, more], ignore_index=True)
    both.to_parquet(tmp_path / "embeddings.parquet")
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op10_pq_near_dedup(spark, str(tmp_path)).collect()}
    want = links_by_hand([(v, [float(z) for z in x], k) for v, x, k in zip(both["vec_id"], both["embedding"], both["label"], strict=True)], 0.93)
    assert got == want and 80 < sum(n for n, _ in want.values()) < 480


def test_vector_query_by_hand(spark):
    pdf = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas()
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op10_pq_near_dedup(spark, DATA).collect()}
    assert got == links_by_hand([(v, [float(z) for z in x], k) for v, x, k in zip(pdf["vec_id"], pdf["embedding"], pdf["label"], strict=True)], 0.93)


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- shared, SQL, pipeline ----------------------------------------------------------------------------------------------


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)] + [(900, 900 + i) for i in range(200)]
    parent = {}

    def find(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in shared.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in list(parent)}
    assert shared.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), duck.sql(queries.SQL[name]).df()
    assert rows_of(got) == rows_of(want)


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA).toPandas()
    full(out)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "packed"]
    stays = in_language_by_hand(docs)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect() if r.doc_id in stays]
    assert len(rows) >= 0.95 * docs.count()  # nearly all of them are clean
    texts = [(d, t) for d, t, _ in cleaned(rows, linededup.MAX_RATIO, True, True, 2)]
    kept = {d for d, c in classes(texts).items() if d == c}
    assert set(out["doc_id"]) == kept
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    size = {d: len(t.encode(x, add_special_tokens=False).ids) + 1 for d, x in texts if d in kept}
    assert out.groupby("doc_id")["length"].sum().to_dict() == size


#: Article 1 of a public declaration in languages that the tables don't have, in the same script; code; encoded data; repetitions.
UNLEARNT = {
    "indonesian": "Semua orang dilahirkan merdeka dan mempunyai martabat dan hak-hak yang sama. Mereka dikaruniai akal dan hati nurani dan hendaknya bergaul satu sama lain dalam semangat persaudaraan.",
    "italian": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "code": "for (int i = 0; i < n; i++) { if (x[i] == null) return foo_bar(x, y->z); } def __init__(self, *args): import numpy as np; print(f'{x!r}') while (k--) { buf[k] ^= key >> (k & 7); } struct node *next = malloc(sizeof *next);",
    "encoded": "aGVsbG8gd29ybGQgdGhpcyBpcyBhIGJhc2U2NCBlbmNvZGVkIHN0cmluZyB0aGF0IGlzIGxvbmc=",
    "letters": "aaaa " * 200,
    "few letters": "aaaa aaaa aaaa",
    "words": "the of and to " * 150,
}


def in_language_by_hand(docs, extra=()):
    """Ids that the pipeline's language stage keeps, by plain counting and quantiles."""
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", (F.pmod(F.xxhash64(F.lit("taught"), "text"), F.lit(3)) != 1).alias("taught")).collect()]
    languages, prior, logp = fitted_by_hand([(t, lang) for _, t, lang, taught in rows if taught and t is not None and lang is not None])

    def shape(text):
        codes = langid._codes(text or "")
        grams = langid.ngram_buckets(codes).tolist()
        if not codes.any():
            return None
        total = logp[grams].sum(axis=0)
        best = int((total + prior).argmax())
        return languages[best], total[best] / len(grams) + langid.BUCKET_BITS * np.log(2), len(grams), np.log(len(set(grams))) / np.log(len(grams))

    labels = {}
    for _, t, lang, taught in rows:
        if not taught and t is not None and lang is not None:
            labels[t] = min(lang, labels.get(t, lang))
    own = [s for t, lang in labels.items() if (s := shape(t)) and s[0] == lang]

    def limits(held):
        middle = np.median([s[1] for s in held])
        below = [(max(0, middle - s[1]), s[2]) for s in held]
        far, near = [d for d, n in below if n >= langid.LONG_TEXT], [d * n**0.5 for d, n in below if n < langid.LONG_TEXT]
        wide = np.quantile(far, langid.QUANTILE) if far else 0
        return middle, wide, np.quantile(near, langid.QUANTILE) if near else wide * langid.LONG_TEXT**0.5

    every = limits(own)
    per = {x: (limits(held)[0], max(limits(held)[1], every[1]), max(limits(held)[2], every[2])) for x in languages if len(held := [s for s in own if s[0] == x]) >= langid.LEAST_CALIBRATION}
    usual = {k: np.median([s[3] for s in own if int(np.log2(s[2])) == k]) for k in {int(np.log2(s[2])) for s in own}}
    spread = max(langid.LEAST_SPREAD, np.quantile([usual[int(np.log2(s[2]))] - s[3] for s in own], langid.VARIETY_QUANTILE))
    out = set()
    for i, t, *_ in [*rows, *extra]:
        if (s := shape(t)) is None:
            continue
        middle, wide, short = per.get(s[0], every)
        near = min(sorted(usual), key=lambda k: abs(k - int(np.log2(s[2]))))
        off = wide if s[2] >= langid.LONG_TEXT else max(wide, short / s[2] ** 0.5)
        if s[1] > max(0, middle - langid.SLACK * off) and s[3] >= usual[near] - langid.VARIETY_SLACK * spread:
            out.add(i)
    return out


def test_language_stage_rejects_other_languages_code_and_repetitions(spark):
    """Texts in unlearnt languages of the same script go, those in learnt ones stay; the same by plain counting."""
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = [(10**6 + k, t, None, "a", None) for k, t in enumerate(UNLEARNT.values())]
    learnt = [r.text[:600] for r in docs.where("lang IS NOT NULL AND length(text) > 2000").dropDuplicates(["lang"]).collect()]
    extra += [(2 * 10**6 + k, t, None, "a", None) for k, t in enumerate(learnt)]
    both = docs.unionByName(spark.createDataFrame(extra, DOCS))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, both, DATA).collect()}
    assert {i for i in kept if i >= 10**6} == {2 * 10**6 + k for k in range(len(learnt))} and len(learnt) == 4
    assert len(kept) - len(learnt) >= 0.97 * docs.count()
    gone = [r.text for r in docs.where("text IS NOT NULL").collect() if r.doc_id not in kept]
    for words in (t.split() for t in gone):  # texts that go say the same words again and again
        assert len(set(words)) < 0.5 * len(words)
    assert kept == in_language_by_hand(both)


def test_quantiles_are_exact(spark):
    """Ties, single values and several kinds over many ranges, as numpy's."""
    rng = random.Random(4)
    rows = [(what, kind, share, rng.choice([0.0, 0.0, round(rng.uniform(-3, 9), 2), rng.random()])) for what, share in (("a", 0.5), ("b", 0.995)) for kind, n in (("", 1), ("x", 2), ("y", 400), ("z", 3001)) for _ in range(n)]
    got = langid._quantiles(spark.createDataFrame(rows, "what string, kind string, share double, value double").repartition(7))
    held = collections.defaultdict(list)
    for what, kind, share, value in rows:
        held[what, kind, share].append(value)
    assert {k: n for k, (_, n) in got.items()} == {k[:2]: len(v) for k, v in held.items()}
    for (what, kind, share), v in held.items():
        assert got[what, kind][0] == pytest.approx(np.quantile(v, share), abs=1e-12)


def test_pipeline_model_and_limits_are_of_all_texts(spark, monkeypatch):
    """More labelled texts than the bound that op1's model has: every one counts, in the priors and in the limits."""
    import corpus_pipeline

    words = F.concat_ws(" ", *[F.concat(F.lit("wort"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(977))) for k in range(5)])
    docs = spark.range(63_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id"), F.when(F.col("id") % 9 == 0, F.translate(words, "wort", "emil")).otherwise(words)).alias("text"), F.when(F.col("id") % 9 == 0, "em").otherwise("wo").alias("lang"))
    seen = []
    monkeypatch.setattr(langid, "reject", lambda docs, model, limits: seen.extend([model, limits]) or docs)
    corpus_pipeline.language(spark, docs, DATA)
    model, limits = seen
    taught = F.pmod(F.xxhash64(F.lit("taught"), "text"), F.lit(3)) != 1
    n = {r["lang"]: r["count"] for r in docs.where(taught).groupBy("lang").count().collect()}
    assert sum(n.values()) > langid.MAX_TRAIN and model.prior == pytest.approx([math.log(n[x] / sum(n.values())) for x in model.languages], abs=1e-12)
    own = langid._judged(docs.where(~taught), model).where("lang = lang_pred").toPandas()
    assert len(own) > 20_000
    for lang, part in [(None, own), *own.groupby("lang")]:
        below = np.maximum(part["evidence"].median() - part["evidence"], 0) * np.sqrt(part["grams"])
        assert limits.evidence[lang][0] == pytest.approx(part["evidence"].median(), abs=1e-12)
        assert limits.evidence[lang][2] >= np.quantile(below, langid.QUANTILE) - 1e-9
    below = np.maximum(own["evidence"].median() - own["evidence"], 0) * np.sqrt(own["grams"])
    assert limits.evidence[None][2] == pytest.approx(np.quantile(below, langid.QUANTILE), abs=1e-9)


def test_limits_without_calibration(spark):
    model = langid.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    none = langid.calibrate(empty(spark), model)
    assert none.evidence == {} and langid.reject(empty(spark), model, none).count() == 0
    kept = [r.doc_id for r in langid.reject(awkward(spark), model, none).collect()]
    assert set(kept) == {1, 4, 6, 7, None} and kept.count(7) == 2


def test_language_stage_rejects_what_is_in_no_language(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = ["xqzjk vwpqx zzkqj qqxw", "qXzKjvWpRt kJxQzWvYpLmXqRtZbHcDf wKvQzXjPyGbTqMx", "Это русский текст о погоде", "123 !!! 456", "", None, "\u4eca\u65e5\u306f\u5929\u6c17"]
    more = spark.createDataFrame([(10**6 + i, t, None, "a", None) for i, t in enumerate([*junk, docs.first()["text"][:60]])], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(more), DATA).collect()}
    assert {i for i in kept if i >= 10**6} == {10**6 + len(junk)} and len(kept) > 0.95 * docs.count()
    unlabelled = more.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in corpus_pipeline.language(spark, unlabelled, DATA).collect()} == {10**6 + i for i in (0, 1, 2, 6, 7)}
    assert corpus_pipeline.lines(spark, docs.drop("n_chars"), DATA).columns == [c for c in docs.columns if c != "n_chars"]


def test_one_whole_document_of_many_copies_is_left(spark):
    import corpus_pipeline

    text = "\n".join(" ".join(f"wort{7 * i + k}" for k in range(12)) for i in range(6))
    rows = [(i, text, "de", "a", len(text)) for i in range(30)]
    rows += [(100 + i, "\n".join(["kopfzeile", *[" ".join(f"w{i}x{j}y{k}" for k in range(9)) for j in range(4)]]), "de", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS)
    cleaned = corpus_pipeline.lines(spark, docs, DATA)
    left = {r.doc_id: r for r in corpus_pipeline.near(spark, cleaned, DATA).collect()}
    assert [r.text for r in left.values() if r.doc_id < 100] == [text] and len(left) == 61
    assert not any("kopfzeile" in r.text or not r.text for r in left.values())


def test_pipeline_stages_on_awkward_rows(spark):
    import corpus_pipeline

    docs = spark.createDataFrame(AWKWARD, DOCS).unionByName(spark.read.parquet(f"{DATA}/documents.parquet").limit(60))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() <= docs.count()
        assert stage(spark, docs.limit(0), DATA).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), DATA).count() == 0
