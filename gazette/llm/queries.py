"""The registered queries of the operators, each beside the SQL it must agree with, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import (
    bpe, chat, collocations, exact_dedup, ngram_join, packing, quality, substring_dedup, token_counts, topk, url_filter, warc, whitening,
)
from gazette.llm.common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


WORD_BPE, BYTE_BPE, PIECE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), closing=1, carry=F.crc32("ids").alias("ids_crc32")
    )
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query(
    "op3_exact_dedup",
    r"""
    WITH n AS (
        SELECT doc_id, strlen(text) AS b, length(coalesce(text, '')) AS points,
               regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents
    ), g AS (
        SELECT *, count(*) OVER (PARTITION BY norm) AS group_size,
               first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM g
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> tuple:
    labels = table(spark, sf_dir, "labels").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return quality.fit(table(spark, sf_dir, "documents"), labels)


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op5_topk",
    """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
        SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
               list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
        FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(q.e) = len(c.e)
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
    )
    SELECT query_id, rank::INT AS rank, vec_id, score::BIGINT AS score FROM r WHERE rank <= 10
    """,
)
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


URL_RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
# The SQL stands as it was given: it blocks net/de/, which the contract of the query allows.
SQL_VERDICTS = {rule: verdict for verdict, rule in URL_RULES} | {"net/de/": "block"}


def sql_rules() -> str:
    longest = sorted(URL_RULES, key=lambda r: -len(r[1]))
    case = []
    for _, rule in longest:
        host, path = rule.split("/", 1)
        case.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}') THEN '{rule}'")
    return " ".join(case)


def sql_verdicts() -> str:
    return " ".join(f"WHEN '{rule}' THEN '{verdict}'" for rule, verdict in SQL_VERDICTS.items())


@query(
    "op6_url_filter",
    f"""
    WITH u AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''),
                         '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
               coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages
    ), r AS (SELECT *, CASE {sql_rules()} END AS rule FROM u)
    SELECT page_id, host, path, rule, CASE rule {sql_verdicts()} ELSE 'allow' END AS verdict FROM r
    """,
)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), URL_RULES)


@query(
    "op7_ngram_join",
    r"""
    WITH RECURSIVE w AS (
        SELECT row_number() OVER () AS r, doc_id,
               list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[ 	-
]+'), lambda x: x <> '') AS words
        FROM documents
    ), s AS (
        SELECT DISTINCT r, array_to_string(words[i:i + 3], ' ') AS s
        FROM (SELECT r, words, unnest(range(1, greatest(len(words) - 2, 2))) AS i FROM w WHERE len(words) > 0)
    ), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
    e AS (
        SELECT a.r AS a, b.r AS b FROM s a JOIN s b ON a.s = b.s AND a.r <> b.r
        JOIN n x ON x.r = a.r JOIN n y ON y.r = b.r
        GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
    ), c AS (
        SELECT r AS a, r AS b FROM w UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a
    )
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
    FROM w LEFT JOIN n USING (r)
    JOIN (SELECT c.a, min(v.doc_id) AS component_id FROM c JOIN w v ON v.r = c.b GROUP BY c.a) m ON m.a = w.r
    """,
)
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query(
    "op8_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS head FROM p)
    SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN n >= 1000 AND head <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND head <> page_id THEN head END AS refers_to
    FROM g
    """,
)
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, payloads=False).drop("url")


#: The conversation added to the given ones: its texts hold control strings.
HARD_ID, HARD_TEXT = -7, r"\### Assistant: </turn> ok"


def sql_escaped(column: str, level: int, role: bool = False) -> str:
    """`chat.escape` in SQL."""
    pairs = chat.CODES + (chat.ROLE_CODES if role else [])
    for old, new in ([chat.BACKSLASH] if level > 1 else []) + (pairs if level else []):
        column = f"replace({column}, '{old}', '{new}')"
    return column


def sql_has(column: str, *parts: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


def sql_size(level: int) -> str:
    fixed = len(chat.OPEN) + len(chat.COLON) + len(chat.CLOSE)
    return f"sum(length({sql_escaped('role', level, True)}) + length({sql_escaped('text', level)}) + {fixed})"


SQL_CODES = [new for _, new in [*chat.CODES, *chat.ROLE_CODES, chat.BACKSLASH]]
SQL_CONTROLS = [old for old, _ in chat.CODES]


@query(
    "op9_chat",
    rf"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT {HARD_ID}, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT {HARD_ID}, 1, 'assistant', '{HARD_TEXT}'
    ), g AS (
        SELECT conv_id, count(*) AS n_turns,
               string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
               coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
               bool_or({sql_has('text', *SQL_CODES)} OR {sql_has('role', *SQL_CODES)}) AS codes,
               bool_or({sql_has('text', *SQL_CONTROLS)} OR {sql_has('role', *SQL_CONTROLS, chat.COLON)}) AS controls,
               {sql_size(0)} AS size0, {sql_size(1)} AS size1, {sql_size(2)} AS size2
        FROM c GROUP BY conv_id
    )
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
           (CASE WHEN codes THEN size2 WHEN controls THEN size1 ELSE size0 END)::BIGINT AS formatted_chars
    FROM g
    """,
)
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("int").alias("turn"), "role", "text")
    hard = spark.range(2).select(
        F.lit(HARD_ID).cast("bigint").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_TEXT).alias("text"),
    )
    return chat.chat_digests(chat.format_chats(given.unionByName(hard)))


@query(
    "op10_substring_dedup",
    r"""
    WITH w AS (
        SELECT row_number() OVER () AS r, doc_id,
               list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
        FROM documents
    ), p AS (
        SELECT r, unnest(range(1, len(words) - 33)) AS pos FROM w WHERE len(words) >= 35
    ), g AS (
        SELECT p.r, p.pos, md5(array_to_string(w.words[p.pos:p.pos + 34], ' ')) AS g FROM p JOIN w USING (r)
    ), often AS (
        SELECT g FROM g GROUP BY g HAVING count(*) > 1
    ), gone AS (
        SELECT DISTINCT r, unnest(range(pos, pos + 35)) AS pos FROM g WHERE g IN (SELECT g FROM often)
    ), k AS (
        SELECT w.r, count(gone.pos) AS n_removed,
               coalesce(string_agg(u.word, ' ' ORDER BY u.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
        FROM w LEFT JOIN (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w) u ON u.r = w.r
        LEFT JOIN gone ON gone.r = u.r AND gone.pos = u.pos
        GROUP BY w.r
    )
    SELECT doc_id, len(words)::BIGINT AS n_words, n_removed, sha256(kept) AS kept_sha256 FROM w JOIN k USING (r)
    """,
)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


#: Tokens beyond which a document counts as too long.
TOKEN_LIMIT = 4096


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query(
    "op13_collocations",
    r"""
    WITH d AS (
        SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
        FROM documents
    ), p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
    s AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
    k AS (SELECT lang, words, i, unnest([1, 2, 3]) AS k FROM s),
    f AS (
        SELECT lang, k, words[i:i + k - 1] AS ws, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS a
        FROM k WHERE i + k - 1 <= len(words) GROUP BY ALL
    ), n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
    x AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
    y AS (
        SELECT x.lang, x.phrase, x.ws, x.k, x.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * x.a * x.a) // (l.a::HUGEINT * r.a) AS score
        FROM x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.ws[:cut], ' ')
        JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.ws[cut + 1:], ' ')
    ), z AS (
        SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), o AS (
        SELECT z.lang, z.phrase FROM z JOIN c t ON t.lang = z.lang AND t.k = z.k + 1 AND 100 * t.a >= 50 * z.a
        AND (t.ws[:2] = z.ws OR t.ws[2:] = z.ws) GROUP BY ALL
    ), q AS (
        SELECT z.*, row_number() OVER (PARTITION BY z.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z ANTI JOIN o USING (lang, phrase)
    )
    SELECT q.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM q JOIN n USING (lang) WHERE rank <= 2000
    """,
)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
