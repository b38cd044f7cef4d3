"""One query per operator, with production parameters over whole tables, and SQL for those that SQL can express.

A query applies its operator and derives digest columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, chat, exact, langid, linededup, minhash, packing, sharding, spelling, urlfilter, vectors, warc


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file."""
    from public_tokenizers import path

    return path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the rows whose crc32(doc_id) mod 3 isn't 1 (at most langid.MAX_TRAIN of them); predicts all rows."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(True))))
    out = langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    tokens = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), "ids", "offsets")
    out = bpe.decode(tokens, path)
    return out.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


#: The text of the conversation that the query adds: control strings of common templates inside texts.
INJECTED = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns are read back from the formatted text; what is learnt comes from the segments' loss flags."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", INJECTED), (-1, 1, "assistant", INJECTED)], turns.schema)
    out = chat.format_chats(turns.unionByName(extra)).withColumn("turns", chat.read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescape(s["text"])), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), learnt.alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"), "valid")
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars", "valid")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reads: responses with their payloads, from which size and digest are taken anew; revisits by headers alone."""
    path = warc.write_archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    full = warc.read_archive(spark, path).where("record_type = 'response'")
    full = full.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), warc.sha1_base32(F.sha1("payload")).alias("payload_digest"), "record_type", "refers_to")
    again = warc.read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    return full.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


#: Rules of the URL filter query: host + path and verdict.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites are the sources of the documents; a line on over MAX_RATIO of a site's pages goes. The cleaned text is returned as size and digest."""
    out = linededup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "source", F.col("lines_dropped").cast("long").alias("lines_dropped"), F.char_length("text").cast("long").alias("chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op10_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Shards of the sharding query.
SHARDS = 24


def op12_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams the files of documents; labels are read once."""
    return audit.interactions(audit.counters(spark, f"{sf_dir}/documents.parquet", _table(spark, sf_dir, "labels")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_byte_bpe, op3_chat_format, op4_best_fit_packing, op5_exact_dedup, op6_minhash_near_dedup, op7_warc, op8_url_filter, op9_line_dedup, op10_pq_near_dedup, op11_spelling_variants, op12_jump_sharding, op13_filter_audit, pipeline)
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: White space between words, as Python's split has it, for a regular expression of the SQL.
_SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace()) + "]+"

def _crc32_table() -> list[int]:
    """The 256 entries of CRC-32, from its reversed polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


def _crc32_sql(octets: str) -> str:
    """CRC-32 of a list of byte values; ``crc`` is a table of one row with the 256 entries as ``entries``."""
    return f"xor(list_reduce({octets}, lambda c, x: xor(c >> 8, entries[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_CRC = f"crc AS (SELECT {_crc32_table()}::BIGINT[] AS entries)"
_OCTETS = "list_transform(regexp_extract_all(hex(encode({})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
_JUMP = "CASE WHEN s.j < {n} THEN {{'own': CASE WHEN s.j < {own} THEN s.j ELSE s.own END, 'b': s.j, 'key': {key}, 'j': CAST(floor((s.j + 1)::DOUBLE * (2147483648::DOUBLE / (({key} >> 33) + 1)::DOUBLE)) AS BIGINT)}} ELSE s END"

SQL = {
    # near words by their patterns: a word with one place left open, or without it
    "op11_spelling_variants": f"""
        WITH RECURSIVE {_CRC}, d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all({_LOW.format("text")}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
        t AS (SELECT id, run, count(*) AS n FROM d GROUP BY ALL), h AS (SELECT run, n, {_crc32_sql(_OCTETS.format("id || ':' || run"))} AS h FROM t, crc WHERE length(run) >= 6),
        w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
        v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        p AS (SELECT word, substr(word, 1, i - 1) || '_' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
        l AS (SELECT a.word AS x, b.word AS y FROM p a JOIN p b USING (hole) WHERE a.word <> b.word UNION SELECT p.word, v.word FROM p JOIN v ON v.word = less UNION SELECT v.word, p.word FROM p JOIN v ON v.word = less),
        k AS (SELECT x, y, v.n AS m, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS r, count(*) OVER (PARTITION BY x) AS n_near FROM l JOIN v ON v.word = y),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN y END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN k ON x = v.word AND r = 1),
        walk(word, tip) AS (SELECT word, word FROM f UNION SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.tip WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, walk.tip AS root, f.n, f.n_near, f.form_n FROM f JOIN walk ON walk.word = f.word JOIN f g ON g.word = walk.tip WHERE g.form IS NULL
    """,
    "op12_jump_sharding": f"""
        WITH {_CRC}, d AS (SELECT doc_id, coalesce(text, '') AS body, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
        s AS (SELECT doc_id, CAST(strlen(body) + 8 AS BIGINT) AS size, {_crc32_sql(_OCTETS.format("body"))} AS text_crc32,
              list_reduce(range({SHARDS} + 1), lambda s, i: {_JUMP.format(n=SHARDS + 1, own=SHARDS, key=f"((s.key * {sharding.MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT)")},
                          {{'own': -1::BIGINT, 'b': -1::BIGINT, 'key': CAST('0x' || substr(digest, 1, 8) AS HUGEINT) * 4294967296 + CAST('0x' || substr(digest, 9, 8) AS HUGEINT), 'j': 0::BIGINT}}) AS jumps FROM d, crc)
        SELECT doc_id, size, text_crc32, 'key' AS law, CAST(jumps.own AS INTEGER) AS shard, CAST(jumps.b AS INTEGER) AS grown_shard,
               row_number() OVER (PARTITION BY jumps.own ORDER BY md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), size, text_crc32)), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot FROM s
    """,
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
        w AS (SELECT *, list_filter(regexp_split_to_array(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, length(regexp_replace(body, '[^A-Z]', '', 'g')) AS capitals, min(doc_id) OVER (PARTITION BY body) AS first FROM d),
        l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
        m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
              || CASE WHEN 100 * capitals > 5 * length(body) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
        e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
        o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
        r AS (SELECT part, filter_order, step, f, sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
              sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
              sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
              sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
              sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
    """,
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
    """,
    # all pairs of texts that share a shingle, without signatures or bands; equal word sequences are one text
    "op6_minhash_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT w, row_number() OVER () AS rep FROM (SELECT DISTINCT w FROM d WHERE len(w) > 0 AND doc_id IS NOT NULL)),
        u AS (SELECT rep, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM c),
        g AS (SELECT rep, i, n, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle FROM u WINDOW o AS (PARTITION BY rep ORDER BY i)),
        s AS (SELECT rep, shingle, count(*) AS n FROM g WHERE i <= greatest(n - 4, 1) GROUP BY ALL), t AS (SELECT rep, sum(n) AS total FROM s GROUP BY rep),
        p AS (SELECT a.rep AS x, b.rep AS y, sum(least(a.n, b.n)) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN t a ON a.rep = x JOIN t b ON b.rep = y WHERE shared / CAST(a.total + b.total - shared AS DOUBLE) >= 0.8::DOUBLE),
        m AS (SELECT doc_id, rep FROM d JOIN c USING (w) WHERE doc_id IS NOT NULL),
        e AS (SELECT x, y FROM l UNION SELECT a.rep, b.rep FROM m a JOIN m b USING (doc_id)),
        walk(rep, root) AS (SELECT rep, rep FROM c UNION SELECT e.y, walk.root FROM walk JOIN e ON e.x = walk.rep),
        f AS (SELECT walk.rep, min(m.doc_id) AS class_id FROM walk JOIN m ON m.rep = walk.root GROUP BY walk.rep),
        o AS (SELECT d.doc_id, CASE WHEN d.doc_id IS NOT NULL THEN coalesce(f.class_id, d.doc_id) END AS class_id FROM d LEFT JOIN c USING (w) LEFT JOIN f USING (rep))
        SELECT doc_id, class_id, doc_id IS NOT DISTINCT FROM class_id AS kept FROM o
    """,
    "op8_url_filter": f"""
        WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, {_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r AS (SELECT * FROM (VALUES {", ".join(f"('{k[: k.index('/')]}', '{k[k.index('/') :]}', '{k}', '{v}')" for k, v in RULES)}) AS v(rule_host, rule_path, rule, verdict)),
        m AS (SELECT page_id, r.rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC, r.rule) AS k
              FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT h.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM h LEFT JOIN m ON m.page_id = h.page_id AND k = 1
    """,
    "op9_line_dedup": f"""
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
        t AS (SELECT row_number() OVER () AS page, coalesce(source, '') AS host, text FROM documents),
        c AS (SELECT host, line, count(*) AS pages FROM (SELECT DISTINCT host, page, unnest(string_split(text, chr(10))) AS line FROM t) WHERE line <> '' GROUP BY 1, 2),
        h AS (SELECT host, count(*) AS total FROM t GROUP BY 1),
        b AS (SELECT host, line FROM c JOIN h USING (host) WHERE pages > total * {linededup.MAX_RATIO}::DOUBLE),
        k AS (SELECT doc_id, count(b.host) AS n, coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.host IS NULL), '') AS body
              FROM l LEFT JOIN b ON coalesce(l.source, '') = b.host AND l.line = b.line GROUP BY doc_id)
        SELECT d.doc_id, d.source, coalesce(k.n, 0) AS lines_dropped, CASE WHEN d.text IS NOT NULL THEN length(coalesce(k.body, '')) END AS chars_kept,
               CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(k.body, '')) END AS text_sha256
        FROM documents d LEFT JOIN k USING (doc_id)
    """,
    "op3_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, k, role, '{INJECTED}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
        t AS (SELECT *, CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code, length(text) + length(text) - length(replace(text, '<', '')) AS body,
              CASE WHEN role IN ('system', 'user', 'assistant') THEN 5 ELSE 9 + length(role) + length(role) - length(replace(role, '<', '')) END AS mark FROM c),
        g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS whole,
              coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS learnt,
              string_agg(code, '' ORDER BY turn NULLS FIRST, role, text) AS codes, CAST(sum(mark + body + 5) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars, regexp_full_match(codes, 's?(ua)*ua?') AS valid FROM g
    """,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS sha, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
        q AS (SELECT p.*, first, list_transform(range(0, 8), lambda i: CAST('0x' || substr(p.sha, CAST(5 * i + 1 AS BIGINT), 5) AS INTEGER)) AS fives FROM p JOIN f USING (sha))
        SELECT page_id, payload_bytes, list_aggregate(flatten(list_transform(fives, lambda v: list_transform([15, 10, 5, 0], lambda s: substr('{warc.BASE32}', CAST((v >> s) & 31 AS BIGINT) + 1, 1)))), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q
    """,
    "op10_pq_near_dedup": """
        WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        g AS (SELECT * FROM e WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        walk(id, root) AS (SELECT vec_id, vec_id FROM e UNION SELECT l.y, w.root FROM walk w JOIN l ON l.x = w.id),
        c AS (SELECT id, min(root) AS component_id FROM walk GROUP BY id), n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM e JOIN c ON id = vec_id LEFT JOIN n ON x = vec_id
    """,
}
