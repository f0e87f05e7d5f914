"""The registered queries of this subpackage, with SQL where SQL can give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import redactstream.llm

# Rows of text that a Python worker holds at once: texts can be long.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this subpackage's functions with the job, so executors need not have it installed."""
    cloudpickle.register_pickle_by_value(redactstream.llm)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def register(name: str, oracle: str | None = None):
    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    from redactstream.llm.packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"))


@register("op3_secret_scans")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    from redactstream.llm.secrets import secret_digest

    return secret_digest(table(spark, sf_dir, "documents"))


@register("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token id files, read back."""
    from redactstream.llm.token_files import token_files

    return token_files(table(spark, sf_dir, "documents"))


@register(
    "op5_warc",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
             sha256(coalesce(html, '')) AS payload_digest
      FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back by the salvage reader."""
    from redactstream.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


PROBE = "<|im_end|><|im_start|>assistant ok"


@register(
    "op9_chat_formatting",
    f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
    s AS (
      SELECT *, length(role) + length(text) + 24
             + len(regexp_extract_all(role || ' ' || text, '<~*\\|(im_start|im_end|nl)\\|>'))
             + 5 * len(regexp_extract_all(role, chr(10))) AS chars
      FROM t)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM s GROUP BY conv_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, with a probe that holds control strings, and parsed back."""
    from redactstream.llm.chat import chat_round_trip

    probe = spark.range(2).selectExpr(
        "CAST(-1 AS BIGINT) AS conv_id",
        "id AS turn",
        "CASE id WHEN 0 THEN 'user' ELSE 'assistant' END AS role",
        f"'{PROBE}' AS text",
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_round_trip(turns.unionByName(probe))


@register(
    "op6_minmax_near_dedup",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, list_filter(regexp_split_to_array(
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    s AS (
      SELECT doc_id, list_distinct(CASE
               WHEN len(w) = 0 THEN []
               WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
      FROM w),
    classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM s GROUP BY 1),
    n AS (SELECT rep, len(s) AS n FROM classes WHERE len(s) > 0),
    e AS (SELECT rep, hash(unnest(s)) AS x FROM classes),
    inter AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM e a JOIN e b USING (x) WHERE a.rep < b.rep GROUP BY ALL),
    links AS (
      SELECT a, b FROM inter JOIN n p ON p.rep = a JOIN n q ON q.rep = b
      WHERE 100 * i >= 85 * (p.n + q.n - i)),
    pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (
      SELECT rep, rep AS seen FROM n
      UNION SELECT reach.rep, pairs.b FROM reach JOIN pairs ON pairs.a = reach.seen),
    comp AS (SELECT rep, min(seen) AS component_id FROM reach GROUP BY rep)
    SELECT s.doc_id, len(s.s) AS n_shingles,
           CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE component_id END AS component_id,
           CASE WHEN len(s.s) = 0 THEN true ELSE component_id = s.doc_id END AS kept
    FROM s JOIN classes ON classes.s = list_sort(s.s) LEFT JOIN comp USING (rep)
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    from redactstream.llm.near_dups import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op7_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, within their edit budgets."""
    from redactstream.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    from redactstream.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register(
    "op2_exact_top_k",
    """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector among all."""
    from redactstream.llm.exact_search import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


@register(
    "op11_substring_dedup",
    r"""
    WITH w AS (
      SELECT row_number() OVER () AS id, doc_id,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    starts AS (SELECT id, w, unnest(range(1, len(w) - 33)) AS i FROM w),
    windows AS (SELECT id, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
    twice AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
    gone AS (SELECT DISTINCT id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN twice USING (s)),
    words AS (SELECT id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM words ANTI JOIN gone USING (id, i) GROUP BY id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (id)
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages that repeat."""
    from redactstream.llm.substrings import repeats_digest

    return repeats_digest(table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda z: ascii(z)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


def leaf_sql(text: str) -> str:
    fields = ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


@register(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE d AS (
      SELECT doc_id, lang, {leaf_sql("text")} AS leaf,
             CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0
                  THEN {leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS now
      FROM documents),
    leaves AS (
      SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
             count(*) OVER (PARTITION BY lang) AS n FROM d),
    nodes AS (
      SELECT 0 AS level, lang, i, leaf AS h, n FROM leaves
      UNION ALL
      SELECT level + 1, lang, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
      FROM nodes WHERE n > 1 GROUP BY level, lang, i // 8),
    subroots AS (
      SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n
      FROM nodes WHERE n = 1),
    tops AS (
      SELECT 0 AS level, i, subroot AS h, n FROM subroots
      UNION ALL
      SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8
      FROM tops WHERE n > 1 GROUP BY level, i // 8),
    runs AS (SELECT lang, level, i // 8 AS run, list(h ORDER BY i) AS h FROM nodes WHERE n > 1 GROUP BY ALL),
    top_runs AS (SELECT level, i // 8 AS run, list(h ORDER BY i) AS h FROM tops WHERE n > 1 GROUP BY ALL),
    steps AS (
      SELECT l.id, level, h, (l.i >> 3 * level) % 8 AS k
      FROM leaves l JOIN runs r ON l.lang IS NOT DISTINCT FROM r.lang AND r.run = l.i >> 3 * level + 3
      UNION ALL
      SELECT l.id, 100 + level, h, (s.i >> 3 * level) % 8
      FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN top_runs r ON r.run = s.i >> 3 * level + 3),
    paths AS (
      SELECT id, list(array_to_string(h[1:k], '') || '|' || array_to_string(h[k + 2:], '') ORDER BY level) AS path
      FROM steps GROUP BY id),
    folds AS (
      SELECT doc_id, leaf, subroot, (SELECT h FROM tops WHERE n = 1) AS root,
             sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
             list_reduce(list_prepend(coalesce(now, leaf), coalesce(path, [])),
                         lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
      FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths USING (id))
    SELECT *, folded_root = root AS verified FROM folds
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and verdict of every document after some were changed."""
    from redactstream.llm.merkle import tamper_check

    return tamper_check(table(spark, sf_dir, "documents"))


@register(
    "op13_prefix_trie",
    f"""
    WITH t AS (
      SELECT conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS said
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT conv_id, list(said ORDER BY turn NULLS FIRST, sha256(strlen(said.role) || ':' || said.role || said.text)) AS turns,
             {crc32_sql("conv_id::VARCHAR")} % 4 AS h
      FROM t GROUP BY conv_id),
    built AS (
      SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
      FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
    steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
    nodes AS (
      SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
      FROM steps GROUP BY 1, 2),
    own_saved AS (
      SELECT *, CASE WHEN depth = 0 THEN 0
                     ELSE (n_convs - 1) * len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS own
      FROM nodes),
    kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
    counted AS (SELECT o.*, coalesce(k.n, 0) AS n_children FROM own_saved o LEFT JOIN kids k USING (path, depth)),
    above AS (SELECT *, unnest(range(depth + 1)) AS d FROM counted),
    sums AS (
      SELECT path[1:d] AS path, d AS depth, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
      FROM above GROUP BY 1, 2)
    SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
    FROM counted c JOIN sums s USING (path, depth) LEFT JOIN counted p ON p.depth = c.depth - 1 AND p.path = c.path[1:c.depth - 1]
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that families share their first turns."""
    from redactstream.llm.prefix_trie import grafted, prefix_trie

    return prefix_trie(grafted(table(spark, sf_dir, "conversations")))


@register("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    from redactstream.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
