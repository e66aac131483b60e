"""The registered queries of this subpackage and the SQL that some are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import budget as B
from millrace.llm import containers as C
from millrace.llm import labels as L
from millrace.llm import mixing as M
from millrace.llm import near_copies as N
from millrace.llm import overlap as O
from millrace.llm import pieces as P
from millrace.llm import sentences as Z
from millrace.llm import tokenizers as T
from millrace.llm import validity as V
from millrace.shared import cut, table

#: The statement of the two problems on word sequences: three words, at least 20 words.
COPIES = N.Digest(threshold=0.7, run_words=3, least_words=20)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), "content")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return N.all_pairs(N.near_copies(_records(spark, d), COPIES))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    g = N.groups(N.near_copies(_records(spark, d), COPIES))
    return g.select(F.col("id").alias("record_id"), "group_id", "n_links")


SPLIT_COPIES = O.Containment(share=0.8, run_words=3, least_words=20)


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), "content", "split_name")
    return O.overlaps(t.where(F.col("split_name").isin("test", "val")), t.where("split_name = 'train'"), SPLIT_COPIES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d).select(F.least("eval_id", "train_id").alias("record_a"), F.greatest("eval_id", "train_id").alias("record_b")).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping evaluation records and their pairs by split, repository and file type, beside all records of the slice."""
    kept = ["record_id", "split_name", "repo", "filetype"]
    t = table(spark, d, "all_hybrid").where(F.col("split_name").isin("test", "val")).select(*kept).dropDuplicates(["record_id"])
    t = t.select("record_id", "split_name", L.repo("repo").alias("repo"), L.filetype("filetype").alias("filetype"))
    pairs = _overlaps(spark, d).groupBy(F.col("eval_id").alias("record_id")).agg(F.count("*").alias("n"))
    return (
        t.join(pairs, "record_id", "left")
        .groupBy("split_name", "repo", "filetype")
        .agg(F.count("*").alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
    )


def _limits(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["limit_name"]: r["limit_value"] for r in table(spark, d, "run_limits").select("limit_name", "limit_value").collect()}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    x = _limits(spark, d)
    cut_up = P.pieces(_records(spark, d), x["item_limit"], x["item_overlap"], texts=False)
    kind = F.when(F.col("longest_line") > x["item_limit"], "inside_line").otherwise("line_ends")
    return cut_up.where("piece = 0").select(F.col("id").alias("record_id"), kind.alias("cut_kind"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    x = _limits(spark, d)
    return P.pieces(_records(spark, d), x["item_limit"], x["item_overlap"]).withColumnRenamed("id", "record_id")


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the pieces of each record, in a form that SQL knows from the record alone."""
    x = _limits(spark, d)
    return P.broken(P.pieces(_records(spark, d), x["item_limit"], x["item_overlap"]), x["item_limit"], x["item_overlap"]).withColumnRenamed("id", "record_id")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    t = _documents(spark, d)
    return Z.sentence_units(t, texts=False, known=Z.learn(t)).select(F.col("id").alias("doc_id"), "start_pos", "end_pos")


def p8_sentences(spark: SparkSession, d: str) -> DataFrame:
    t = _documents(spark, d)
    return Z.sentence_units(t, known=Z.learn(t)).withColumnRenamed("id", "doc_id")


def _code(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), L.filetype("filetype").alias("language"), F.col("content").alias("text"))


def _code_counts(spark: SparkSession, d: str) -> DataFrame:
    t = _code(spark, d)
    return B.estimates(t, B.models(t))


def p4_record_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _code_counts(spark, d).select(F.col("id").alias("record_id"), "n_bytes", "n_tokens")


def p4_slice_tokens(spark: SparkSession, d: str) -> DataFrame:
    repos = table(spark, d, "repos").select(L.repo("repo").alias("repo"), "domain_name")
    labels = table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), L.repo("repo").alias("repo"), L.filetype("filetype").alias("filetype"))
    return B.totals(_code_counts(spark, d), labels.join(repos, "repo", "left"), ["repo", "filetype", "domain_name"])


def p4_slice_bytes(spark: SparkSession, d: str) -> DataFrame:
    """The part of the totals that needs no model."""
    return p4_slice_tokens(spark, d).drop("n_tokens")


def p4_slice_errors(spark: SparkSession, d: str) -> DataFrame:
    """Totals by file type and domain beside the true ones: here every text is tokenized."""
    t = cut(_code(spark, d).dropDuplicates(["id"]), "code")
    repos = table(spark, d, "repos").select(L.repo("repo").alias("repo"), "domain_name")
    labels = table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), L.repo("repo").alias("repo"), L.filetype("filetype").alias("filetype")).join(repos, "repo", "left")
    true = T.token_counts(t).withColumnRenamed("n_tokens", "true_tokens")
    both = B.estimates(t, B.models(t)).join(true, "id").join(labels.dropDuplicates(["id"]), "id")
    out = both.groupBy("filetype", "domain_name").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), F.sum("true_tokens").alias("true_tokens"))
    return out.withColumn("error", F.col("n_tokens") / F.greatest("true_tokens", F.lit(1)) - 1)


def p4_document_bytes(spark: SparkSession, d: str) -> DataFrame:
    return p4_document_tokens(spark, d).drop("n_tokens")


def p4_models(spark: SparkSession, d: str) -> DataFrame:
    return B.models(_code(spark, d)).drop("weights")


def p4_document_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), L.language("lang").alias("language"), "text", L.source("source").alias("source"), "domain_name")
    return B.totals(B.estimates(t, B.models(t)), t.select("id", "source", F.col("language").alias("lang"), "domain_name"), ["source", "lang", "domain_name"])


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    x = C.Packing(capacity=_limits(spark, d)["container_capacity"])
    return C.packed(_documents(spark, d), x).withColumnRenamed("id", "doc_id")


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full containers are, and how often two texts in one have the same language tag, beside what chance would give."""
    x = C.Packing(capacity=_limits(spark, d)["container_capacity"])
    tags = table(spark, d, "documents").select(F.col("doc_id").alias("id"), L.language("lang").alias("lang"))
    return C.fill(C.packed(_documents(spark, d), x).join(tags, "id"), x.capacity, "lang")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of every packing, as counts that SQL knows without a tokenizer."""
    x = C.Packing(capacity=_limits(spark, d)["container_capacity"])
    placed = cut(C.packed(_documents(spark, d), x), "placed")
    n = placed.agg(F.countDistinct("id").alias("n_documents"), F.count_if(F.col("piece") == 0).alias("n_first_pieces"))
    return n.crossJoin(F.broadcast(C.broken(placed, x.capacity)))  # one row each


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), L.source("source").alias("source"), "text")
    sized = cut(T.token_counts(t, keep=["source"]), "sized")
    return M.mixed(sized, table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of each source of a mix: no document above its repeats, and no source under its share that could give more."""
    mix, report = _mix(spark, d)
    most = mix.groupBy("source").agg(F.max("copies").alias("most"), F.countDistinct("id").alias("ids"), F.count("*").alias("rows"))
    kept = F.coalesce((F.col("most") <= F.col("max_repeats")) & (F.col("ids") == F.col("rows")), F.lit(True))
    used_up = F.col("mix_tokens") >= 0.999 * F.col("source_tokens") * F.col("max_repeats")
    met = used_up | (F.col("mix_share") >= F.col("target_share") * 0.99 - 0.001)
    return report.join(most, "source", "left").select("source", "n_documents", kept.alias("caps_kept"), met.alias("share_met"))


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return V.checked(table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), "filetype", "content"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).where("size(accepted_by) = 0").select(F.col("id").alias("record_id"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), L.repo("repo").alias("repo")).dropDuplicates(["id"])
    names = table(spark, d, "filetype_names").select("filetype", "language_name")
    return V.rates(_checked(spark, d).join(t, "id").join(names, "filetype", "left"), ["repo", "language_name"])


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    """The part of the rates that needs no parser."""
    return p3_rates(spark, d).select("repo", "language_name", "n_files")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def _runs_sql(rows: str) -> str:
    """Tables s (id, run), the distinct runs of three words of texts of at least 20 words, and n (id, n)."""
    return f"""w AS MATERIALIZED (SELECT id, list_transform(regexp_extract_all(any_value(content), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM ({rows}) WHERE content IS NOT NULL GROUP BY id),
    s AS MATERIALIZED (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM w WHERE len(w) >= 20),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY id)"""


_ALL = "SELECT record_id AS id, content, split_name FROM all_hybrid"
_PAIRS_SQL = f"""WITH {_runs_sql(_ALL)}, p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.run = b.run AND a.id < b.id GROUP BY 1, 2)
    SELECT a AS record_a, b AS record_b FROM p JOIN n AS x ON x.id = a JOIN n AS y ON y.id = b WHERE 10 * k >= 7 * (x.n + y.n - k)"""
_OVERLAP_SQL = f"""WITH {_runs_sql(_ALL)}, e AS (SELECT DISTINCT record_id AS id FROM all_hybrid WHERE split_name IN ('test', 'val')), t AS (SELECT DISTINCT record_id AS id FROM all_hybrid WHERE split_name = 'train'),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM (SELECT * FROM s SEMI JOIN e USING (id)) AS a JOIN (SELECT * FROM s SEMI JOIN t USING (id)) AS b ON a.run = b.run AND a.id <> b.id GROUP BY 1, 2)
    SELECT a, b FROM p JOIN n ON n.id = a WHERE 10 * k >= 8 * n"""


_REPO_SQL = "nullif(regexp_replace(lower(trim(repo)), '/+$', ''), '')"
_TYPE_SQL = "nullif(regexp_replace(lower(trim(filetype)), '^\\.', ''), '')"
_SOURCE_SQL = "regexp_replace(nullif(lower(trim(source)), ''), '[- ]+', '_', 'g')"
_TAG_SQL = "regexp_extract(lower(trim(lang)), '^[a-z]+')"
_LANGUAGE_SQL = f"nullif(coalesce(map_from_entries([{', '.join(f'({k!r}, {v!r})' for k, v in L.LANGUAGES.items())}])[{_TAG_SQL}], {_TAG_SQL}), '')"


def oracle_sql() -> dict[str, str]:
    lines = "list_max(list_transform(regexp_split_to_array(content, '\\r\\n|\\r|\\n'), lambda x: length(x)))"
    return {
        "p1_found": _PAIRS_SQL,
        "p1_groups": f"""WITH RECURSIVE pairs AS MATERIALIZED ({_PAIRS_SQL}), both_ways AS (SELECT record_a AS a, record_b AS b FROM pairs UNION ALL SELECT record_b, record_a FROM pairs),
            reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach AS r JOIN both_ways AS e ON e.a = r.b),
            words AS MATERIALIZED (SELECT record_id AS id, array_to_string(list_transform(regexp_extract_all(any_value(content), '[A-Za-z0-9_]+'), lambda x: lower(x)), ' ') AS w, len(regexp_extract_all(any_value(content), '[A-Za-z0-9_]+')) AS k FROM all_hybrid WHERE content IS NOT NULL GROUP BY 1),
            links AS (SELECT x.w, count(DISTINCT y.w)::BIGINT AS n FROM both_ways JOIN words AS x ON x.id = a JOIN words AS y ON y.id = b WHERE x.w <> y.w GROUP BY 1)
            SELECT id AS record_id, least(id, coalesce((SELECT min(b) FROM reach WHERE a = id), id)) AS group_id, coalesce(n, 0)::BIGINT AS n_links FROM words LEFT JOIN links USING (w) WHERE k >= 20""",
        "p2_found": f"SELECT record_id, CASE WHEN {lines} > 6000 THEN 'inside_line' ELSE 'line_ends' END AS cut_kind FROM (SELECT record_id, any_value(content) AS content FROM all_hybrid GROUP BY 1) WHERE length(content) > 6000",
        "p6_checks": "SELECT count(*)::BIGINT AS n_documents, count(*)::BIGINT AS n_first_pieces, 0::BIGINT AS n_over, 0::BIGINT AS n_apart, 0::BIGINT AS n_split FROM documents",
        "p2_checks": "SELECT record_id, md5(content) AS digest, 0::BIGINT AS n_over, 0::BIGINT AS n_apart, 0::BIGINT AS n_unlike, 0::BIGINT AS n_unforced FROM (SELECT record_id, any_value(content) AS content FROM all_hybrid GROUP BY 1) WHERE length(content) > 6000",
        "p4_slice_bytes": f"""SELECT repo, filetype, domain_name, count(*)::BIGINT AS n_texts, sum(b)::BIGINT AS n_bytes FROM (SELECT record_id, any_value(strlen(coalesce(content, ''))) AS b, any_value({_REPO_SQL}) AS repo, any_value({_TYPE_SQL}) AS filetype FROM all_hybrid GROUP BY 1)
            LEFT JOIN (SELECT {_REPO_SQL} AS repo, domain_name FROM repos) USING (repo) GROUP BY 1, 2, 3""",
        "p4_document_bytes": f"SELECT {_SOURCE_SQL} AS source, {_LANGUAGE_SQL} AS lang, domain_name, count(*)::BIGINT AS n_texts, sum(strlen(text))::BIGINT AS n_bytes FROM documents GROUP BY 1, 2, 3",
        "p7_checks": f"SELECT m.source, count(d.source)::BIGINT AS n_documents, true AS caps_kept, true AS share_met FROM mix_targets AS m LEFT JOIN (SELECT {_SOURCE_SQL} AS source FROM documents) AS d USING (source) GROUP BY 1",
        "p3_files": f"""SELECT repo, language_name, count(*)::BIGINT AS n_files FROM (SELECT record_id, any_value({_REPO_SQL}) AS repo, any_value({_TYPE_SQL}) AS filetype FROM all_hybrid WHERE regexp_matches(content, '[^\\s\\x0B\\x1C-\\x1F\\x85\\p{{Z}}]') GROUP BY 1)
            LEFT JOIN filetype_names USING (filetype) WHERE filetype IN ('cry', 'saw', 'py', 'json') GROUP BY 1, 2""",
        "p5_found": f"SELECT DISTINCT least(a, b) AS record_a, greatest(a, b) AS record_b FROM ({_OVERLAP_SQL})",
        "p5_counts": f"""WITH o AS ({_OVERLAP_SQL}), t AS (SELECT DISTINCT record_id, split_name, nullif(regexp_replace(lower(trim(repo)), '/+$', ''), '') AS repo, nullif(regexp_replace(lower(trim(filetype)), '^\\.', ''), '') AS filetype
                FROM all_hybrid WHERE split_name IN ('test', 'val')), c AS (SELECT a AS record_id, count(*) AS n FROM o GROUP BY 1)
            SELECT split_name, repo, filetype, count(*)::BIGINT AS n_records, count(n)::BIGINT AS n_overlapping, coalesce(sum(n), 0)::BIGINT AS n_pairs FROM t LEFT JOIN c USING (record_id) GROUP BY 1, 2, 3""",
    }
