"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftline.llm import alignment, chat, decontaminate, exact, licenses, media, packing, pieces, quality, repair, simhash, toxicity, urls


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("n_tokens", "ids_sha256", "decoded_sha256")
    return pieces.encode(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), wanted)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read(spark, sf_dir, "documents"))


def op3_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so the media table is made from embeddings."""
    return media.media_copies(media.pictures(read(spark, sf_dir, "embeddings")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs))


URL_RULES = (
    urls.Rule("com", "/en/", "block"), urls.Rule("example.com", "/en/7", "allow"), urls.Rule("net", "/de/", "allow"),
    urls.Rule("example.net", "/de/8", "block"), urls.Rule("org", "/es/", "block"),
)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') t(conv_id, turn, role, text)"
    )
    made = chat.format_chats(talks.unionByName(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chat.read_back(made).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    plan, turns = repair.repair(repair.damaged(talks))
    ids = talks.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = repair.of_each(repair.of_each(ids, plan), repair.turn_digests(turns))
    counts = (repair.column_or(c, 0) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"))
    return out.select("conv_id", *counts, repair.column_or("audit", ""), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, a, b = read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.alignment_counts(docs, a, b, digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = decontaminate.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sentencepiece": op1_sentencepiece,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_media_copies": op3_media_copies,
        "op4_quality": op4_quality,
        "op5_url_filter": op5_url_filter,
        "op6_packing": op6_packing,
        "op7_license_scan": op7_license_scan,
        "op8_simhash": op8_simhash,
        "op9_toxicity": op9_toxicity,
        "op10_chat_format": op10_chat_format,
        "op11_repair": op11_repair,
        "op12_alignment": op12_alignment,
        "op13_decontaminate": op13_decontaminate,
    }


def _escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in chat.DEFAULT.control:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP2_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""

OP10_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS ends
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), refused AS (
  SELECT conv_id, coalesce(
    min(place) FILTER (WHERE before || ' ' || role NOT IN ({", ".join(f"'{a} {b}'" for a, b in chat.DEFAULT.transitions)})),
    max(place + 1) FILTER (WHERE ends AND role NOT IN ({", ".join(f"'{r}'" for r in chat.DEFAULT.finals)}))
  ) AS first_bad_turn FROM placed GROUP BY conv_id
)
SELECT c.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum({chat.DEFAULT.overhead} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars,
  any_value(first_bad_turn) IS NULL AS valid, any_value(first_bad_turn) AS first_bad_turn
FROM c JOIN refused USING (conv_id) GROUP BY c.conv_id
"""


def _canonical(text: str) -> str:
    out = f"lower({text})"
    for pattern, new in licenses.SPELLINGS:
        pattern = pattern.replace("\n", "\\n").replace("\t", "\\t")
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


def _known_rows() -> str:
    quoted = lambda s: s.replace("'", "''")
    return ", ".join(f"('{k}', '{quoted(t)}')" for k, t in licenses.KNOWN_TEXTS)


def _paragraphs(text: str) -> str:
    cut = f"string_split_regex({text}, '{licenses.PARAGRAPHS.replace(chr(10), chr(92) + 'n')}')"
    return f"list_filter(list_transform({cut}, lambda x: {_canonical('x')}), lambda x: x <> '')"


OP7_SQL = f"""
WITH known AS (
  SELECT DISTINCT license_id, sha256(array_to_string(p, ' ')) AS h, p[1] AS lead, len(p) AS n
  FROM (SELECT license_id, {_paragraphs('t')} AS p FROM (VALUES {_known_rows()}) v(license_id, t))
), d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, {_paragraphs("coalesce(text, '')")} AS p FROM documents
), w AS (SELECT doc_id, t, p, sha256(array_to_string(p, ' ')) AS digest FROM d), e AS (
  SELECT doc_id, digest, digest AS h, 'whole' AS kind FROM w
  UNION ALL
  SELECT doc_id, digest, sha256({_canonical('line')}), 'line' FROM (SELECT doc_id, digest, unnest(string_split(t, chr(10))) AS line FROM w)
  UNION ALL
  SELECT doc_id, digest, sha256(array_to_string(p[i:i + n - 1], ' ')), 'run'
  FROM (SELECT doc_id, digest, p, unnest(range(1, len(p) + 1)) AS i FROM w) x JOIN (SELECT DISTINCT lead, n FROM known WHERE n > 1) k ON p[i] = lead
  WHERE i + n - 1 <= len(p) AND n < len(p)
)
SELECT doc_id, digest, max(license_id) FILTER (WHERE kind = 'whole') AS whole_license,
  coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id), '') AS licenses,
  count(license_id) FILTER (WHERE kind = 'line') AS matched_lines, count(license_id) FILTER (WHERE kind = 'run') AS matched_runs
FROM e LEFT JOIN known USING (h) GROUP BY doc_id, digest
"""


def _words(text: str) -> str:
    low = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP13_SQL = f"""
WITH b AS (
  SELECT item, w, least(len(w), {decontaminate.WINDOW}) AS n FROM (SELECT coalesce(cast(item_id AS VARCHAR), '') AS item, {_words('text')} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_words('text')} AS w FROM documents
), runs AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS said FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)
), met AS MATERIALIZED (SELECT runs.r, runs.i, runs.n, win.item FROM runs JOIN win USING (n, said)), hit AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM met) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT r, item FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


def _options(state: int) -> str:
    """The best of deleting, rerolling and keeping the row with symbol s, as structs (cost, audit)."""
    move = lambda edit, cost, to: f"{{'c': v{to}.c + {cost}, 'a': '{edit}' || v{to}.a}}"
    after, never = repair.NEXT[state], "{'c': 1000000, 'a': ''}"
    late = "CASE WHEN s = upper(s) THEN 1 ELSE 0 END"
    kept = [(x, repair.kept_state(x, state)) for x in repair.ROLES]
    keeps = " ".join(f"WHEN lower(s) = '{x}' THEN {move('K', late, to)}" for x, to in kept if to is not None)
    return f"list_min([{move('D', 3, state)}, CASE WHEN s <> 'd' THEN {move('R', f'2 + {late}', after)} ELSE {never} END, CASE {keeps} ELSE {never} END])"


def _or_insert(own: str, other: str) -> str:
    return f"list_min([{own}, {{'c': {other}.c + 2, 'a': 'I' || {other}.a}}])"


_SPACE_CHARS = " || ".join(f"chr({ord(c)})" for c in " \t\n\x0b\x0c\r")
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: "
    "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
)
OP11_SQL = f"""
WITH RECURSIVE c AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), drawn AS MATERIALIZED (SELECT *, {_CRC} % 20 AS g FROM c), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM (
    SELECT conv_id, turn, CASE g WHEN 4 THEN 'user' ELSE role END AS role, CASE g WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(range(CASE g WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM drawn)
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    CASE WHEN ini IN ('u', 'a', 's') THEN ini ELSE 'o' END AS kind, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM (SELECT *, rtrim(text, {_SPACE_CHARS}) AS bare, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || substr(role, 1, 1) AS pair FROM placed)
), rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(kind) ELSE kind END AS symbol FROM judged
), w AS MATERIALIZED (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal,
    string_agg(symbol, '' ORDER BY pos) AS word FROM rows_ GROUP BY conv_id
), walk AS (
  SELECT word, len(word) AS n, {{'c': 0, 'a': ''}} AS v0, {{'c': 4, 'a': 'II'}} AS v1, {{'c': 2, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM (SELECT DISTINCT word FROM w)
  UNION ALL
  SELECT word, n - 1, {_or_insert('b0', 'x2')}, {_or_insert('b1', 'x2')}, x2, x3 FROM (
    SELECT word, n, b0, b1, {_or_insert('b2', 'b3')} AS x2, {_or_insert('b3', 'b2')} AS x3 FROM (
      SELECT word, n, {', '.join(f'{_options(q)} AS b{q}' for q in range(4))} FROM (SELECT *, substr(word, n, 1) AS s FROM walk WHERE n > 0)))
), plan AS MATERIALIZED (
  SELECT w.*, v0.c::BIGINT AS cost, v0.a AS audit FROM w JOIN (SELECT word, v0 FROM walk WHERE n = 0) USING (word)
), edits AS (
  SELECT conv_id, edit, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER o AS pos, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER o AS j
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS edit, unnest(range(len(audit))) AS i FROM plan WHERE audit <> '') WINDOW o AS (PARTITION BY conv_id ORDER BY i)
), turns AS (
  SELECT e.conv_id, edit, j, r.role, r.text, max(CASE WHEN j = 1 AND edit = 'K' AND r.symbol IN ('s', 'S') THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS lead
  FROM (SELECT * FROM edits WHERE edit <> 'D') e LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos
), made AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha
  FROM turns GROUP BY conv_id
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_repair": OP11_SQL, "op13_decontaminate": OP13_SQL, "op2_exact_dedup": OP2_SQL, "op7_license_scan": OP7_SQL, "op10_chat_format": OP10_SQL}
