"""Queries of these operators over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnloom.llm import (
    bpe,
    decontamination,
    jaccard,
    lines,
    manifest,
    neighbours,
    packing,
    pii,
    quality,
    suffixes,
    toxicity,
    tries,
    warc,
)
from txnloom.llm.shared import ship, table, written

MULTI_RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back, with digests of both."""
    path, pattern = public_tokenizers.path(MULTI_RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # The decoded bytes take the place of the text, which nothing needs any more.
    both = bpe.encode(docs, path, pattern, decoded="text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, with the verdict of each language's threshold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id",
        (toxicity.fold_of("doc_id") == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.DECISION).cast("int").alias("predicted"),
        (F.col("score") >= toxicity.threshold(model)).alias("rejected"),
    )


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the 200-byte strings that occur elsewhere, as digest."""
    done = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and guaranteed verdict of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality.judge(docs, table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the personal data in all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    return found.select(
        "doc_id",
        *[pii.count_of(kind).alias(f"n_{kind}") for kind in pii.BASE_KINDS],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii")).alias("spans"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place in a sequence of 2048 tokens for every piece of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)
    cut = written(cut.drop("ids"), "pieces")
    return packing.pack(cut, ["doc_id", "piece"], rows_expected=cut.count())


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of every document."""
    done = lines.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id",
        F.col("removed_lines").cast("long").alias("n_removed_lines"),
        F.length("text").cast("long").alias("n_chars_left"),
        F.sha2("text", 256).alias("left_sha256"),
    )


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a damaged replica of the pages' records.

    The replica is a copy in which records of some pages have a byte changed,
    are cut short, or are missing; the audit has to find them all.
    """
    pages = table(spark, sf_dir, "pages")
    records = written(warc.records(pages, pages.count()), "warc")
    byte = F.lit(b"?")
    damaged = (
        F.when(F.col("page_id") % 97 == 3, F.concat(byte, F.substring("data", 2, 2**31 - 1)))
        .when(F.col("page_id") % 101 == 5, F.expr("substring(data, 1, octet_length(data) - 1)"))
        .otherwise(F.col("data"))
    )
    replica = records.filter("page_id IS NULL OR page_id % 103 <> 7").withColumn("data", damaged)
    return warc.audit(records, replica).select("page_id", "status", F.col("length").alias("n_bytes"))


OP10_SQL = """
SELECT page_id,
    CASE WHEN page_id % 103 = 7 THEN 'missing'
        WHEN page_id % 97 = 3 OR page_id % 101 = 5 THEN 'changed' ELSE 'intact' END AS status,
    CAST(strlen(concat('WARC/1.0', url, coalesce(html, ''), coalesce(CAST(page_id AS VARCHAR), 'none'),
        CAST(strlen(coalesce(html, '')) AS VARCHAR))) + 120 AS BIGINT) AS n_bytes
FROM pages
"""


def op11_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all rebuilt conversations."""
    return tries.trie(tries.rebuilt(table(spark, sf_dir, "conversations")))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and proof, and what a tampered third of them leads to."""
    docs = table(spark, sf_dir, "documents")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", decontamination.CAPITALS, decontamination.SMALL)
    return manifest.audit(docs, changed={"text": F.when(chosen, lowered).otherwise(F.col("text"))}).drop("copied")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark windows, and their items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", decontamination.n_hit())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _crc32_sql(decimal: str) -> str:
    """CRC-32 of a decimal number, with the table of the remainders of single bytes."""
    remainders = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        remainders.append(value)
    digits = f"list_transform(string_split(CAST({decimal} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    step = f"xor(c >> 8, {remainders}[CAST((xor(c, b) & 255) + 1 AS INTEGER)])"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {digits}), lambda c, b: {step}), 4294967295)"


OP11_SQL = f"""
WITH own AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_crc32_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)),
both_parts AS (
    SELECT c.conv_id, 0 AS part, o.n, o.role, o.text FROM convs c
        JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.n <= c.h
    UNION ALL
    SELECT c.conv_id, 1, o.n, o.role, o.text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.n > c.h),
paths AS (
    SELECT conv_id, row_number() OVER w AS depth,
        sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS node,
        len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM both_parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
    UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
linked AS (SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS up,
    depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths),
nodes AS (
    SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
    FROM linked GROUP BY node, depth),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.up = n.node AND c.depth = n.depth + 1) AS n_children FROM nodes n),
sums AS (
    SELECT p.node, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved
    FROM counted c JOIN paths p ON p.conv_id = c.conv_id AND p.depth <= c.depth GROUP BY p.node)
SELECT c.conv_id, c.depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
    CAST(s.saved AS BIGINT) AS saved_tokens, sha256(c.ended) AS ends_sha256
FROM counted c JOIN sums s ON s.node = c.node LEFT JOIN nodes u ON u.node = c.up AND c.depth > 0
"""


def _op5_sql() -> str:
    tests = [(rule, cut) for rule, cuts in quality.CUTOFFS.items() for cut in cuts]
    share, level = quality.LIMIT / len(quality.CUTOFFS), quality.ERROR / len(tests)
    ratios = {
        "symbol_ratio": ("n_symbols", "word_chars"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "mean_word": ("word_chars", "n_words"),
    }
    measure = " ".join(f"WHEN '{r}' THEN CASE WHEN {b} > 0 THEN {a} / {b}::DOUBLE ELSE 0 END" for r, (a, b) in ratios.items())
    return rf"""
WITH split AS (
    SELECT row_number() OVER () AS line, doc_id, lang, coalesce(text, '') AS t FROM documents),
parts AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM split),
grams AS (
    SELECT line, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT line, w, unnest(generate_series(1, len(w) - 7)) AS i FROM parts WHERE len(w) > 8)),
again AS (SELECT line, g FROM grams GROUP BY line, g HAVING count(*) > 1),
hit AS (
    SELECT line, count(DISTINCT p) AS n
    FROM (SELECT line, unnest(generate_series(i, i + 7)) AS p FROM grams JOIN again USING (line, g)) GROUP BY line),
counted AS (
    SELECT line, doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(hit.n, 0) AS n_repeat_words,
        len(l) AS n_lines, len(w) < 20 OR 100 * coalesce(hit.n, 0) > 30 * len(w) AS base_failed
    FROM parts LEFT JOIN hit USING (line)),
tests(rule, cutoff) AS (VALUES {", ".join(f"('{r}', {c}::DOUBLE)" for r, c in tests)}),
measured AS (SELECT c.*, rule, cutoff, CASE rule {measure} END > cutoff AS beyond FROM counted c, tests),
holdout AS (
    SELECT * FROM measured
    WHERE doc_id IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
strata AS (SELECT greatest(1, count(DISTINCT coalesce('=' || lang, '-'))) AS strata FROM holdout),
tails AS (
    SELECT lang, rule, cutoff, n, k FROM (
        SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (beyond) AS k
        FROM holdout WHERE NOT base_failed GROUP BY lang, rule, cutoff)),
passed AS (
    SELECT lang, rule, min(cutoff) AS cutoff FROM tails, strata
    WHERE k < {share} * n AND list_sum(list_transform(generate_series(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1)
        - lgamma(n - j + 1) + j * ln({share}::DOUBLE) + (n - j) * ln(1 - {share}::DOUBLE)))) <= {level} / strata
    GROUP BY lang, rule),
rejected AS (
    SELECT DISTINCT m.line FROM measured m JOIN passed p ON p.lang IS NOT DISTINCT FROM m.lang
        AND p.rule = m.rule AND p.cutoff = m.cutoff WHERE m.beyond)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND line NOT IN (SELECT line FROM rejected) AS kept
FROM counted
"""


def _tree_sql(name: str, group: str, levels: int) -> str:
    """CTEs ``name``0 to ``name``<levels>: the nodes (group, pos, total, digest) of each level."""
    steps = [
        f"{name}{k + 1} AS (SELECT {group}, pos // 8 AS pos, (any_value(total) + 7) // 8 AS total, "
        f"CASE WHEN any_value(total) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest "
        f"FROM {name}{k} GROUP BY {group}, pos // 8)"
        for k in range(levels)
    ]
    return ",\n".join(steps)


def _sides_sql(name: str, levels: int, row: str) -> str:
    """Columns with the digests left and right of a row's way at each level."""
    columns = []
    for k in range(levels):
        same = f"n.grp IS NOT DISTINCT FROM {row}.{name}_grp AND n.pos // 8 = {row}.{name}_at // {8 ** (k + 1)}"
        for side, than in (("left", "<"), ("right", ">")):
            columns.append(
                f"coalesce((SELECT string_agg(n.digest, '' ORDER BY n.pos) FROM {name}{k} n "
                f"WHERE {same} AND n.pos {than} {row}.{name}_at // {8 ** k}), '') AS {name}_{side}{k}"
            )
    return ", ".join(columns)


_LEVELS = (8, 3)


def _op12_sql() -> str:
    parts = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"]

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in [*parts, text]) + ")"

    lowered = f"CASE WHEN {_crc32_sql('doc_id')} % 3 = 0 THEN translate(text, '{decontamination.CAPITALS}', '{decontamination.SMALL}') ELSE text END"
    trees = _tree_sql("leaf", "grp", _LEVELS[0]), _tree_sql("top", "grp", _LEVELS[1])
    sides = [_sides_sql(n, m, "w") for n, m in zip(("leaf", "top"), _LEVELS, strict=True)]
    folds, last, proof = [], "start", []
    for name, levels in zip(("leaf", "top"), _LEVELS, strict=True):
        for k in range(levels):
            left, right = f"{name}_left{k}", f"{name}_right{k}"
            proof += [left, right]
            folds.append((f"{name}{k}_", f"CASE WHEN {name}_total > {8 ** k} THEN sha256({left} || {last} || {right}) ELSE {last} END"))
            last = f"{name}{k}_"
    chained = "way"
    ctes = []
    for i, (column, value) in enumerate(folds):
        ctes.append(f"fold{i} AS (SELECT *, {value} AS {column} FROM {chained})")
        chained = f"fold{i}"
    return f"""
WITH leaves AS (
    SELECT doc_id, lang AS grp, {leaf('text')} AS digest, {leaf('changed')} AS start
    FROM (SELECT *, {lowered} AS changed FROM documents)),
leaf0 AS (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
        count(*) OVER (PARTITION BY grp) AS total FROM leaves),
{trees[0]},
top0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS pos, count(*) OVER () AS total,
    digest, grp AS lang FROM leaf{_LEVELS[0]}),
{trees[1]},
w AS (
    SELECT l.doc_id, l.digest AS leaf, l.start, t.digest AS subroot, r.digest AS root,
        l.grp AS leaf_grp, l.pos AS leaf_at, l.total AS leaf_total, 0 AS top_grp, t.pos AS top_at, t.total AS top_total
    FROM leaf0 l JOIN top0 t ON t.lang IS NOT DISTINCT FROM l.grp, top{_LEVELS[1]} r),
way AS (SELECT w.*, {sides[0]}, {sides[1]} FROM w),
{", ".join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256({" || ".join(proof)}) AS proof_sha256,
    {last} AS folded_root, {last} = root AS verified
FROM {chained}
"""


OP12_SQL = _op12_sql()

OP13_SQL = r"""
WITH split AS (
    SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
words AS (
    SELECT kind, id, row_number() OVER () AS line, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split),
grams AS (
    SELECT DISTINCT id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
    FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM words WHERE kind = 'b' AND len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (
    SELECT line, n, unnest(generate_series(1, len(w) - n + 1)) AS i, w FROM words, sizes WHERE kind = 'd' AND len(w) >= n),
hits AS (
    SELECT p.line, p.i, p.n, g.id FROM places p JOIN grams g ON g.n = p.n AND g.gram = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')),
covered AS (
    SELECT line, count(DISTINCT pos) AS n_hit FROM (SELECT line, unnest(generate_series(i, i + n - 1)) AS pos FROM hits) GROUP BY line),
items AS (
    SELECT line, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT line, CAST(id AS VARCHAR) AS id FROM hits WHERE id IS NOT NULL) GROUP BY line)
SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
    sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (line) LEFT JOIN items i USING (line) WHERE w.kind = 'd'
"""


def _shipped(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(run)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(spark, sf_dir)

    return query


_ALL = (
    op1_bpe,
    op2_toxicity,
    op3_jaccard,
    op4_suffixes,
    op5_quality,
    op6_neighbours,
    op7_lines,
    op8_pii,
    op9_packing,
    op10_warc,
    op11_tries,
    op12_manifest,
    op13_decontamination,
)
QUERIES = {run.__name__: _shipped(run) for run in _ALL}
ORACLES = {
    "op5_quality": _op5_sql(),
    "op10_warc": OP10_SQL,
    "op11_tries": OP11_SQL,
    "op12_manifest": OP12_SQL,
    "op13_decontamination": OP13_SQL,
}
