"""One registered query for each corpus operator, over its whole table, with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    attention,
    filter_audit,
    one_permutation,
    packing,
    piece_prefixes,
    quality_rules,
    resharding,
    simhash,
    spelling,
    suffix_trees,
    token_counts,
    transducer,
    warc,
)
from tidemark.llm.common import new_folder
from tidemark.storage import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Tokens of a training sequence, for the flag of longer documents.
LONG_DOCUMENT = 512
#: Documents scored at or above this are predicted to be good.
GOOD = 0.3
OLD_SHARDS, NEW_SHARDS = 6, 8


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counted = token_counts.count_tokens(docs, new_folder(spark, "token-cache"), vocabulary())
    return counted.withColumn("over_limit", F.col("n_tokens") > LONG_DOCUMENT)


@query
def op2_bpe_transducer(spark, sf_dir):
    coded = transducer.encode(table(spark, sf_dir, "documents"), vocabulary())
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_quality_rules(spark, sf_dir):
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _quality_rules_sql() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rates = {
        "symbol_rate": "n_symbols * 1000",
        "shout_rate": "n_shouts * 1000",
        "word_length": "word_chars * 100",
        "line_rate": "n_dup_lines * 1000",
        "repeat_rate": "n_repeat_words * 1000",
    }
    long = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r} AS value FROM rated WHERE {r} IS NOT NULL" for r in rates)
    steps = ", ".join(f"('{r}', {s})" for r, s in quality_rules.RULES.items())

    def quartiles(by: str) -> str:
        group = f"{by}, " if by else ""
        return f"""SELECT {group}rule, max(total) AS total, min(CASE WHEN below * 4 >= total THEN bucket END) AS q25,
            min(CASE WHEN below * 4 >= total * 3 THEN bucket END) AS q75
        FROM (SELECT {group}rule, bucket, sum(n) OVER (PARTITION BY {group}rule ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {group}rule) AS total
            FROM (SELECT {group}rule, bucket, sum(n) AS n FROM sketch GROUP BY {group}rule, bucket)) GROUP BY {group}rule"""

    over = " OR ".join(f"coalesce({r} > max(CASE WHEN rule = '{r}' THEN fence END), false)" for r in rates)
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, CASE WHEN trim(t, {spaces}) = '' THEN [] ELSE regexp_split_to_array(trim(t, {spaces}), '[ \\t-\\r]+') END AS w FROM d),
win AS (SELECT id, g.i AS p, w[g.i] || chr(32) || w[g.i + 1] || chr(32) || w[g.i + 2] AS x
    FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i) AS g),
hit AS (SELECT id, p FROM (SELECT id, p, count(*) OVER (PARTITION BY id, x) AS n FROM win) WHERE n > 1),
cov AS (SELECT id, count(DISTINCT p + k) AS n FROM hit, range(3) AS r(k) GROUP BY id),
ln AS (SELECT id, count(*) - count(DISTINCT line) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE trim(line, {spaces}) <> '' GROUP BY id),
m AS (SELECT d.id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {spaces}, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')) AS BIGINT) AS n_symbols, length(t) - length(translate(t, '!', '')) AS n_shouts,
    CAST(coalesce(ln.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
    FROM w AS d LEFT JOIN cov ON cov.id = d.id LEFT JOIN ln ON ln.id = d.id),
rated AS (SELECT *, {", ".join(f"CASE WHEN n_words > 0 THEN ({e}) // n_words END AS {r}" for r, e in rates.items())} FROM m),
long AS ({long}),
sketch AS (SELECT lang, source, rule, (value >> greatest(0, length(bin(value)) - 6)) << greatest(0, length(bin(value)) - 6) AS bucket, count(*) AS n
    FROM long GROUP BY ALL),
own AS ({quartiles("lang, source")}), bylang AS ({quartiles("lang")}), whole AS ({quartiles("")}),
picked AS (SELECT own.lang, own.source, rule, step,
    CASE WHEN own.total >= {quality_rules.LEAST_DOCUMENTS} THEN own.q25 WHEN bylang.total >= {quality_rules.LEAST_DOCUMENTS} THEN bylang.q25 ELSE whole.q25 END AS q25,
    CASE WHEN own.total >= {quality_rules.LEAST_DOCUMENTS} THEN own.q75 WHEN bylang.total >= {quality_rules.LEAST_DOCUMENTS} THEN bylang.q75 ELSE whole.q75 END AS q75
    FROM own JOIN bylang USING (lang, rule) JOIN whole USING (rule) JOIN (VALUES {steps}) AS s(rule, step) USING (rule)),
fences AS (SELECT lang, source, rule, q75 + {quality_rules.SPREAD} * greatest(q75 - q25, step) AS fence FROM picked),
judged AS (SELECT rated.id, any_value(COLUMNS(rated.* EXCLUDE (id))),
    bool_or(coalesce(CASE rule {" ".join(f"WHEN '{r}' THEN {r}" for r in rates)} END > fence, false)) AS over_any
    FROM rated LEFT JOIN fences ON fences.lang = rated.lang AND fences.source = rated.source GROUP BY rated.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed,
    NOT (n_words < {quality_rules.LEAST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words) AND NOT coalesce(over_any, false) AS kept
FROM judged"""


ORACLES["op3_quality_rules"] = _quality_rules_sql()


@query
def op4_flow_resharding(spark, sf_dir):
    """The documents, laid out in six shards by source, are moved to eight of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    old = new_folder(spark, "old-shards")
    home = F.coalesce(F.crc32(F.col("source").cast("binary")), F.lit(0)) % OLD_SHARDS
    resharding.lay_out(docs, old, home)
    moved = resharding.reshard(docs, old, new_folder(spark, "new-shards"), NEW_SHARDS)
    return moved.select(
        "doc_id",
        F.col(resharding.SIZE).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col(resharding.NEW).alias("shard"),
        F.col(resharding.SLOT).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_warc_revisits(spark, sf_dir):
    folder = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(warc.read_archives(spark, folder))


ORACLES["op5_warc_revisits"] = f"""WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= {warc.LEAST_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id < original THEN original END AS refers_to FROM p LEFT JOIN o USING (payload_digest)"""


@query
def op6_one_permutation(spark, sf_dir):
    return one_permutation.against_next(table(spark, sf_dir, "documents"))


@query
def op7_simhash_pivots(spark, sf_dir):
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op8_suffix_trees(spark, sf_dir):
    cut = suffix_trees.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_attention_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = attention.train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return attention.scored(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= GOOD, 1).otherwise(0).alias("predicted")
    )


@query
def op10_configuration_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query
def op11_spelling_chunks(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def _spelling_sql() -> str:
    """Checksums by shifts of single bits, near words by their common deletions."""
    return f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{{{spelling.LEAST_CHARS},}}')) AS run FROM documents),
k AS (SELECT id, run, count(*) AS c FROM runs GROUP BY id, run),
b AS (SELECT run, c, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes FROM k),
h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(bytes, lambda x: [CAST(x AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END)) AS h FROM b),
words AS (SELECT CASE WHEN h % {spelling.NOISE} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n
    FROM h GROUP BY 1 HAVING sum(c) >= {spelling.LEAST_COUNT} AND length(word) >= {spelling.LEAST_CHARS}),
gaps AS (SELECT word, n, pos, CASE WHEN pos < 0 THEN word ELSE left(word, pos) || substr(word, pos + 2) END AS gap FROM (SELECT word, n, unnest(range(-1, length(word))) AS pos FROM words)),
near AS (SELECT DISTINCT x.word, y.word AS near, y.n AS m FROM gaps AS x JOIN gaps AS y ON x.gap = y.gap AND x.word <> y.word AND (x.pos = y.pos OR x.pos < 0 OR y.pos < 0)),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
named AS (SELECT word, m, n_near, min(near) AS near FROM best JOIN near USING (word, m) GROUP BY word, m, n_near),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.LEAST_RATIO} * n THEN near END AS form, CASE WHEN m >= {spelling.LEAST_RATIO} * n THEN m END AS form_n
    FROM words LEFT JOIN named USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN forms ON forms.word = root WHERE forms.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""


ORACLES["op11_spelling_chunks"] = _spelling_sql()


@query
def op12_filter_ranks(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _filter_ranks_sql() -> str:
    spaces = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
w AS (SELECT d.*, first, CASE WHEN trim(t, {spaces}) = '' THEN [] ELSE regexp_split_to_array(trim(t, {spaces}), '[ \\t-\\r]+') END AS w FROM d JOIN firsts USING (t)),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 50 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails
    FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
p AS (SELECT a || b || c || e || g AS filter_order FROM {letters} AS v1(a), {letters} AS v2(b), {letters} AS v3(c), {letters} AS v4(e), {letters} AS v5(g)
    WHERE len(list_distinct([a, b, c, e, g])) = 5),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter, fails, n, good, toxic, position(filter_order[step] IN fails) > 0 AS hit,
    length(translate(fails, filter_order[1:step - 1], '')) = length(fails) AS alive FROM m, p, range(1, 6) AS r(step)),
o AS (SELECT part, filter_order, step, letter, CAST(sum(CASE WHEN alive AND NOT hit THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN alive AND hit THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN hit AND NOT alive THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails = letter THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN alive AND hit THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN alive AND hit THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost FROM s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM o"""


ORACLES["op12_filter_ranks"] = _filter_ranks_sql()

@query
def op13_piece_prefixes(spark, sf_dir):
    coded = piece_prefixes.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
