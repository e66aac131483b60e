"""The registered queries of the core, each over whole tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import tokens as K
from millrace.functions.draws import uniform_sql
from millrace.operators import fim, metrics, pack, split, stats
from millrace.operators.buffers import assign_buffers, budget
from millrace.plans.pipelines import Packer, examples, placed_segments, pretrain_corpus, sft_corpus
from millrace.plans.pipelines import sft_files as supervised_files
from millrace.shared import fresh, local, table
from millrace.sources.jsonl import read_jsonl, replayed, require_columns, with_ordinals, write_jsonl

#: A public vocabulary for the plug-in tokenizer.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

#: The constants of the packing queries: small windows and buffers, so that tables of every size fill several.
PACK = Packer(seq_length=256, num_of_sequences=64, chars_per_token=3.6, fim_rate=0.0)
MOST = budget(256, 3.6, 64)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "all_hybrid").select(F.col("record_id").alias("id"), "content", F.col("set_name").alias("set"), "filetype", "ingested_at")


#: The order of the corpus; rows that repeat in full are in any order, which changes no result.
ORDER = ["id", "ingested_at"]


def ordered(spark: SparkSession, d: str, *columns: str | Column) -> DataFrame:
    """Columns of the corpus, `id` and `content` unless given, with the places of its rows."""
    return with_ordinals(corpus(spark, d).select("id", "ingested_at", *(columns or ("content",))), ORDER).drop("ingested_at")


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return ordered(spark, d, F.length("content").alias("units"))


def first_rows(spark: SparkSession, d: str, n: int, *columns: str) -> DataFrame:
    """The first rows, picked by each task and then from what they picked."""
    return split.head(corpus(spark, d).select("id", "ingested_at", *columns), n, ORDER)


def digest(array: str) -> Column:
    return F.md5(F.array_join(F.col(array), ",").cast("binary"))


CORPUS_SQL = "SELECT record_id AS id, content, set_name, filetype, ingested_at FROM all_hybrid"
ORDERED_SQL = "SELECT record_id AS id, content, row_number() OVER (ORDER BY record_id NULLS FIRST, ingested_at NULLS FIRST) - 1 AS ord FROM all_hybrid"
CODEPOINTS_SQL = "CASE WHEN length({0}) > 0 THEN list_transform(string_split({0}, ''), lambda c: unicode(c)::BIGINT) ELSE []::BIGINT[] END"
EOS, PAD = K.BEYOND.eos, K.BEYOND.padding


# --- sources and filters ----------------------------------------------------------------------------------


@query("SELECT record_id AS id, length(content)::BIGINT AS n_chars, set_name AS \"set\", filetype FROM all_hybrid")
def scan_corpus(spark, d):
    return corpus(spark, d).select("id", F.length("content").cast("bigint").alias("n_chars"), "set", "filetype")


@query("SELECT record_id AS id, filetype FROM all_hybrid WHERE set_name = 'unsupervised'")
def filter_unsupervised(spark, d):
    return split.of_set(corpus(spark, d), "unsupervised").select("id", "filetype")


@query("SELECT record_id AS id, filetype FROM all_hybrid WHERE set_name = 'supervised'")
def filter_supervised(spark, d):
    return split.of_set(corpus(spark, d), "supervised", strict=True).select("id", "filetype")


@query("SELECT record_id AS id, filetype FROM all_hybrid WHERE filetype IN ('cry', 'saw', 'txt')")
def filter_filetypes(spark, d):
    return split.of_filetypes(corpus(spark, d)).select("id", "filetype")


# --- splits -----------------------------------------------------------------------------------------------


def _split_sql(types: str, columns: str) -> str:
    return f"""WITH r AS (SELECT id, filetype, row_number() OVER (PARTITION BY filetype ORDER BY {uniform_sql(42, "split", "id")}, id) AS rank,
        count(*) OVER (PARTITION BY filetype) AS n FROM ({CORPUS_SQL}) WHERE set_name = 'unsupervised' AND filetype IN ({types}))
    SELECT {columns}, CASE WHEN rank <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r"""


@query(_split_sql("'cry', 'saw', 'txt'", "id, filetype"))
def split_train_eval(spark, d):
    return split.split_by_filetype(corpus(spark, d)).select("id", "filetype", "split")


@query(_split_sql("'cry', 'absent'", "id, filetype"))
def split_absent_type(spark, d):
    return split.split_by_filetype(corpus(spark, d), filetypes=("absent", "cry")).select("id", "filetype", "split")


@query("SELECT id, filetype, part, row_number() OVER (PARTITION BY split ORDER BY part, rank) - 1 AS ord, split FROM (" + _split_sql("'cry', 'saw', 'txt'", "id, filetype, rank, CASE filetype WHEN 'cry' THEN 0 WHEN 'saw' THEN 1 ELSE 2 END::BIGINT AS part") + ")")
def union_parts(spark, d):
    """Train and test, each the parts of its file types in order, one behind the other."""
    both = split.split_by_filetype(corpus(spark, d)).select("id", "filetype", "split", F.col("place").cast("bigint"), "split_draw")
    train, test = (with_ordinals(both.where(F.col("split") == s), ["place", "split_draw", "id"]) for s in ("train", "test"))
    return train.unionByName(test).select("id", "filetype", F.col("place").alias("part"), "ord", "split")


_SFT_SQL = f"""SELECT id, filetype, CASE WHEN rank <= greatest(1, floor(0.95::DOUBLE * n)) THEN 'train' ELSE 'val' END AS split FROM (
    SELECT id, filetype, row_number() OVER (PARTITION BY filetype ORDER BY {uniform_sql(4371, "sft", "id")}, id) AS rank, count(*) OVER (PARTITION BY filetype) AS n
    FROM ({CORPUS_SQL}) WHERE set_name = 'supervised')"""


@query(_SFT_SQL)
def sft_split(spark, d):
    return split.sft_split(corpus(spark, d)).select("id", "filetype", "split")


@query(f"SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY {uniform_sql(4371, 'shuffle', 'id')}, id) - 1 AS ord FROM ({_SFT_SQL})")
def sft_shuffle_order(spark, d):
    train, val = sft_corpus(corpus(spark, d).drop("content"))
    return train.select("id", F.lit("train").alias("split"), "ord").union(val.select("id", F.lit("val").alias("split"), "ord"))


# --- statistics -------------------------------------------------------------------------------------------


@query("SELECT set_name AS \"set\", count(*)::BIGINT AS n FROM all_hybrid GROUP BY 1")
def counts(spark, d):
    return stats.counts(corpus(spark, d), "set")


@query("SELECT filetype, count(*)::BIGINT AS n FROM all_hybrid WHERE set_name = 'supervised' GROUP BY 1")
def group_by_filetype(spark, d):
    return stats.counts(split.of_set(corpus(spark, d), "supervised"), "filetype")


@query(f"SELECT id, ord FROM ({ORDERED_SQL}) WHERE ord < 400")
def head_sample(spark, d):
    place = F.row_number().over(Window.orderBy(*ORDER)).cast("bigint") - 1
    return first_rows(spark, d, 400).select("id", place.alias("ord"))


_COUNTED_SQL = f"SELECT id, t FROM (SELECT id, {CODEPOINTS_SQL.format('content')} AS t FROM ({CORPUS_SQL}))"


@query(f"SELECT id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ',')) AS digest FROM ({_COUNTED_SQL})")
def tok_codepoint(spark, d):
    t = corpus(spark, d).select("id", K.codepoints(F.col("content")).alias("t"))
    return t.select("id", F.size("t").cast("bigint").alias("n_tokens"), digest("t").alias("digest"))


_WORDS_SQL = "list_transform(regexp_extract_all(coalesce({0}, ''), '([A-Za-z0-9_]+|[^A-Za-z0-9_])', 1), lambda w: ('0x' || substr(md5(w), 1, 8))::BIGINT % 32768)"


@query(f"SELECT id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ',')) AS digest FROM (SELECT record_id AS id, {_WORDS_SQL.format('content')} AS t FROM all_hybrid)")
def tok_words(spark, d):
    t = corpus(spark, d).select("id", K.words()(F.col("content")).alias("t"))
    return t.select("id", F.size("t").cast("bigint").alias("n_tokens"), digest("t").alias("digest"))


@query("SELECT record_id AS id, md5(coalesce(content, '')) AS digest FROM all_hybrid")
def tok_vocabulary(spark, d):
    """A plug-in tokenizer there and back, which must give the texts again; the file lies on every executor."""
    there, back = K.vocabulary_file(VOCABULARY, names_are_text=True), K.vocabulary_text(VOCABULARY)
    t = corpus(spark, d).select("id", there(F.col("content")).alias("t")).select("id", back(F.col("t")).alias("text"))
    return t.select("id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"SELECT id, len(t)::BIGINT AS n_plain, md5(array_to_string(list_concat([{K.BEYOND.unk}], t, [{EOS}]), ',')) AS digest FROM ({_COUNTED_SQL})")
def tok_specials(spark, d):
    """Tokens without specials, which are counted, and with begin and end tokens around them."""
    on, off = K.enclosed(K.codepoints, K.BEYOND.unk, EOS), K.codepoints
    t = corpus(spark, d).select("id", on(F.col("content")).alias("on"), off(F.col("content")).alias("off"))
    return t.select("id", F.size("off").cast("bigint").alias("n_plain"), digest("on").alias("digest"))


@query("""WITH t AS (SELECT * FROM special_tokens WHERE token_role <> 'middle'), n AS (SELECT * FROM (VALUES (0, 'suffix', '<|fim_suffix|>'), (1, 'prefix', '<|fim_prefix|>'), (2, 'middle', '<|fim_middle|>'), (3, 'fim_pad', '<|fim_pad|>')) AS v(k, role, name)),
    f AS (SELECT k, role, (SELECT min(token_id) FROM t WHERE token_text = name) AS found FROM n), u AS (SELECT *, found IS NULL OR found = (SELECT min(token_id) FROM t WHERE token_role = 'unk') AS missing FROM f)
    SELECT k::BIGINT AS place, role, CASE WHEN missing THEN (SELECT max(token_id) FROM t) + sum(missing::INTEGER) OVER (ORDER BY k) ELSE found END::BIGINT AS token_id FROM u""")
def sentinels_by_name(spark, d):
    """The four sentinels, in their order, by name in a vocabulary that lacks one; it is given the next id."""
    found = K.table_special(table(spark, d, "special_tokens").where("token_role <> 'middle'")).sentinels()
    return local(spark, list(zip(range(4), ("suffix", "prefix", "middle", "fim_pad"), found)), "place bigint, role string, token_id bigint")


@query(f"""SELECT sum(length(coalesce(content, '')))::BIGINT AS n_chars, sum(len({_WORDS_SQL.format('content')}))::BIGINT AS n_tokens,
    sum(length(coalesce(content, '')))::DOUBLE / greatest(sum(len({_WORDS_SQL.format('content')})), 1) AS ratio FROM ({ORDERED_SQL}) WHERE ord < 400""")
def chars_token_ratio(spark, d):
    """Over the first 400 rows, as the pipeline takes it."""
    return stats.chars_token_ratio(first_rows(spark, d, 400, "content"), "content", K.words()(F.col("content")))


@query(f"SELECT greatest(1, (sum(len(t))::BIGINT + 223) // 224)::BIGINT AS estimated FROM ({_COUNTED_SQL})")
def estimate_length(spark, d):
    t = corpus(spark, d).select(K.codepoints(F.col("content")).alias("tokens"))
    return stats.estimated_length(t, 256, 0.125)


# --- fill in the middle -----------------------------------------------------------------------------------


def _permuted_sql(rows: str, rate: float, spm: float, truncate: bool = False, seed: int = 7) -> str:
    """Rows (id, t, ...) with `o`, the permuted tokens."""
    p, s, m = K.BEYOND.prefix, K.BEYOND.suffix, K.BEYOND.middle
    rest = "CASE WHEN n - hi > 3 THEN t[hi + 1 : n - 3] ELSE [] END" if truncate else "t[hi + 1 : n]"
    out = f"""CASE WHEN u_spm < {spm}::DOUBLE THEN list_concat([{p}, {s}], {rest}, [{m}], t[1 : lo], t[lo + 1 : hi])
        ELSE list_concat([{p}], t[1 : lo], [{s}], {rest}, [{m}], t[lo + 1 : hi]) END"""
    keep = "u_apply >= " + f"{rate}::DOUBLE" + (" OR n - hi <= 3" if truncate else "")
    draws = ", ".join(f"{uniform_sql(seed, b, 'id')} AS {u}" for b, u in (("b0", "u0"), ("b1", "u1"), ("spm", "u_spm"), ("apply", "u_apply")))
    return f"""SELECT *, CASE WHEN {keep} THEN t ELSE {out} END AS o FROM (
        SELECT *, least(floor(u0 * (n + 1)), floor(u1 * (n + 1)))::BIGINT AS lo, greatest(floor(u0 * (n + 1)), floor(u1 * (n + 1)))::BIGINT AS hi FROM (SELECT *, len(t) AS n, {draws} FROM ({rows})))"""


def _fim_sql(rate: float, spm: float, truncate: bool) -> str:
    return f"SELECT id, len(o)::BIGINT AS n_tokens, md5(array_to_string(o, ',')) AS digest FROM ({_permuted_sql(_COUNTED_SQL, rate, spm, truncate)})"


def _fim(spark, d, rate: float, spm: float, truncate: bool = False, special: K.SpecialTokens = K.BEYOND) -> DataFrame:
    t = corpus(spark, d).select("id", K.codepoints(F.col("content")).alias("t"))
    o = t.withColumn("o", fim.permute(F.col("t"), "id", special, rate, spm, seed=7, truncate=truncate))
    return o.select("id", F.size("o").cast("bigint").alias("n_tokens"), digest("o").alias("digest"))


@query(_fim_sql(1.0, 0.0, False))
def fim_psm(spark, d):
    return _fim(spark, d, 1.0, 0.0)


@query(_fim_sql(1.0, 1.0, False))
def fim_spm(spark, d):
    return _fim(spark, d, 1.0, 1.0)


@query(_fim_sql(0.125, 0.5, False))
def fim_mixed(spark, d):
    return _fim(spark, d, 0.125, 0.5)


@query(_fim_sql(1.0, 0.5, True))
def fim_truncated(spark, d):
    return _fim(spark, d, 1.0, 0.5, True)


@query(f"SELECT id, len(t)::BIGINT AS n_tokens, md5(array_to_string(t, ',')) AS digest FROM ({_COUNTED_SQL})")
def fim_disabled(spark, d):
    """Without sentinels nothing is permuted, whatever the rate."""
    return _fim(spark, d, 1.0, 0.5, special=K.SpecialTokens(eos=EOS))


# --- buffers and windows ----------------------------------------------------------------------------------


def _buffers_sql(rows: str, most: float | str = MOST) -> str:
    """Buffers by recursion over starts: the next begins behind the first row at which the sum since the start reaches the budget."""
    return f"""r AS MATERIALIZED ({rows}), c AS MATERIALIZED (SELECT *, (sum(coalesce(units, 0)) OVER (ORDER BY ord))::DOUBLE AS upto FROM r),
    b AS (SELECT 0::BIGINT AS buf, 0::BIGINT AS first, 0::DOUBLE AS base UNION ALL
        SELECT buf + 1, (SELECT min(ord) FROM c WHERE upto >= base + {most}) + 1, (SELECT min(upto) FROM c WHERE upto >= base + {most})
        FROM b WHERE (SELECT min(ord) FROM c WHERE upto >= base + {most}) + 1 <= (SELECT max(ord) FROM c)),
    f AS (SELECT c.*, b.buf FROM c ASOF JOIN b ON c.ord >= b.first)"""


_UNITS_SQL = f"SELECT id, content, ord, length(content) AS units FROM ({ORDERED_SQL})"


@query(f"WITH RECURSIVE {_buffers_sql(_UNITS_SQL)} SELECT id, ord, buf FROM f")
def greedy_buffers(spark, d):
    return assign_buffers(lengths(spark, d), MOST, "units").select("id", "ord", "buf")


def _offsets_sql(rows: str, tokens: str, most: float | str = MOST) -> str:
    return f"""{_buffers_sql(rows, most)}, s AS MATERIALIZED (SELECT id, ord, buf, list_concat({tokens}, [{EOS}]) AS seg FROM f),
    o AS MATERIALIZED (SELECT *, len(seg)::BIGINT AS n, (sum(len(seg)) OVER (PARTITION BY buf ORDER BY ord) - len(seg))::BIGINT AS off, (sum(len(seg)) OVER (PARTITION BY buf))::BIGINT AS total FROM s)"""


_TOKENS_SQL = CODEPOINTS_SQL.format("content")


@query(f"WITH RECURSIVE {_offsets_sql(_UNITS_SQL, _TOKENS_SQL)} SELECT id, ord, buf, n, off, total FROM o")
def eos_offsets(spark, d):
    return placed_segments(ordered(spark, d), PACK).select("id", "ord", "buf", "n", "off", "total")


def _windows_sql(rows: str, tokens: str, stride: int, columns: str = "", size: int = 256, most: float | str = MOST) -> str:
    return f"""WITH RECURSIVE {_offsets_sql(rows, tokens, most)}, t AS (SELECT buf, off + k - 1 AS pos, token FROM (SELECT buf, off, unnest(seg) AS token, generate_subscripts(seg, 1) AS k FROM o)),
    x AS (SELECT buf, pos, token, unnest(range(greatest(0, (pos - {size} + {stride}) // {stride}), pos // {stride} + 1))::BIGINT AS win FROM t), i AS (SELECT buf, win, list(token ORDER BY pos) AS part FROM x GROUP BY 1, 2),
    p AS (SELECT buf, win, list_concat(part, list_transform(range(0, {size} - len(part)), lambda k: {PAD}::BIGINT)) AS ids FROM i),
    e AS (SELECT buf, win, ids, list_transform(ids, lambda t: CASE WHEN t = {PAD} THEN -100 ELSE t END) AS labels FROM p)
    SELECT buf, win, md5(array_to_string(ids, ',')) AS ids_digest, md5(array_to_string(labels, ',')) AS labels_digest{columns} FROM e"""


def _digests(made: DataFrame, *more: str) -> DataFrame:
    return made.select("buf", "win", digest("input_ids").alias("ids_digest"), digest("labels").alias("labels_digest"), *more)


@query(_windows_sql(_UNITS_SQL, _TOKENS_SQL, 256))
def pack_windows(spark, d):
    return _digests(examples(ordered(spark, d), PACK))


@query(_windows_sql(_UNITS_SQL, _TOKENS_SQL, 224))
def pack_overlap(spark, d):
    return _digests(examples(ordered(spark, d), replace(PACK, overlap_ratio=0.125)))


@query(_windows_sql(_UNITS_SQL, _TOKENS_SQL, 384))
def pack_gaps(spark, d):
    return _digests(examples(ordered(spark, d), replace(PACK, overlap_ratio=-0.5)))


@query("SELECT buf, win, row_number() OVER (PARTITION BY buf ORDER BY " + uniform_sql(1003, "bufshuf", "buf", "win") + ", win) - 1 AS place FROM (" + _windows_sql(_UNITS_SQL, _TOKENS_SQL, 256) + ")")
def pack_shuffled(spark, d):
    return examples(ordered(spark, d), replace(PACK, shuffle=True, seed=3, epoch=1)).select("buf", "win", "place")


@query(f"WITH RECURSIVE {_offsets_sql(_UNITS_SQL, _TOKENS_SQL)} SELECT sum((total + 223) // 224)::BIGINT AS actual FROM (SELECT DISTINCT buf, total FROM o)")
def actual_length(spark, d):
    return stats.actual_length(placed_segments(ordered(spark, d), PACK), 256, 0.125)


_TWICE_SQL = f"SELECT id, content, ord + e * (SELECT count(*) FROM all_hybrid) AS ord, units, e::INTEGER AS epoch FROM ({_UNITS_SQL}), range(0, 2) AS t(e)"


@query(f"WITH RECURSIVE {_buffers_sql(_TWICE_SQL)} SELECT id, epoch, ord, buf FROM f")
def epoch_replay(spark, d):
    """Two epochs; a buffer may run on from one into the next."""
    t = lengths(spark, d)
    again = replayed(t, 2, parts=t.agg(F.max("part").alias("m")).first()["m"] + 1)
    return assign_buffers(again, MOST, "units").select("id", "epoch", "ord", "buf")


@query(f"SELECT id, ord, r::INTEGER AS replica FROM ({ORDERED_SQL}), range(0, 3) AS t(r)")
def worker_replicas(spark, d):
    """What loader workers that don't share the data would each see."""
    return replayed(ordered(spark, d, F.lit(1).alias("one")), 1, replicas=3).select("id", "ord", "replica")


_PRE_SQL = "SELECT record_id AS id, content, row_number() OVER (ORDER BY record_id NULLS FIRST, tokenizer_tag NULLS FIRST, array_to_string(content, ',') NULLS FIRST) - 1 AS ord, len(content) AS units FROM pretokenised"


@query(_windows_sql(_PRE_SQL, "coalesce(content, [])", 256))
def pretokenised_pack(spark, d):
    """Token lists as they are; the budget then counts tokens."""
    t = table(spark, d, "pretokenised").select(F.col("record_id").alias("id"), "content", "tokenizer_tag", F.array_join("content", ",").alias("text"))
    placed = with_ordinals(t, ["id", "tokenizer_tag", "text"]).select("id", "content", "ord", "part")
    return _digests(examples(placed, replace(PACK, already_tokenized=True)))


@query("SELECT buf, win, ord // 5 AS batch, ord // 10 AS step FROM (SELECT buf, win, row_number() OVER (ORDER BY buf, win) - 1 AS ord FROM (" + _windows_sql(_UNITS_SQL, _TOKENS_SQL, 256) + "))")
def batch_assign(spark, d):
    made = with_ordinals(examples(ordered(spark, d), PACK).select("buf", "win"), ["buf", "win"])
    return pack.batches(made).select("buf", "win", "batch", "step")


# --- metrics ----------------------------------------------------------------------------------------------


@query("SELECT run_id, global_step, CASE WHEN eval_loss < 20 THEN round(exp(eval_loss), 6) ELSE 'inf'::DOUBLE END AS perplexity FROM metrics_log WHERE eval_loss IS NOT NULL")
def perplexity(spark, d):
    return metrics.with_perplexity(table(spark, d, "metrics_log")).select("run_id", "global_step", F.round("perplexity", 6).alias("perplexity"))


@query("SELECT run_id, round(exp(min(eval_loss)), 2) AS perplexity FROM metrics_log WHERE eval_loss IS NOT NULL GROUP BY 1")
def final_perplexity(spark, d):
    best = table(spark, d, "metrics_log").where("eval_loss IS NOT NULL").groupBy("run_id").agg(F.min("eval_loss").alias("loss"))
    return best.select("run_id", metrics.final_perplexity("loss").alias("perplexity"))


@query("""SELECT run_id, global_step, eval_loss, place FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY eval_loss, global_step) AS place
    FROM (SELECT run_id, global_step, min(eval_loss) AS eval_loss FROM metrics_log WHERE eval_loss IS NOT NULL GROUP BY 1, 2)) WHERE place <= 2""")
def best_checkpoint(spark, d):
    return metrics.best_checkpoints(table(spark, d, "metrics_log"))


@query("""WITH o AS (SELECT run_id, global_step, min(eval_loss) AS loss FROM metrics_log WHERE eval_loss IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT *, min(CASE WHEN isnan(loss) THEN NULL ELSE loss END) OVER (PARTITION BY run_id ORDER BY global_step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY run_id ORDER BY global_step) AS k FROM o),
    g AS (SELECT *, coalesce(NOT isnan(loss) AND (best IS NULL OR loss < best), false) AS better FROM b),
    s AS (SELECT *, k - coalesce(max(CASE WHEN better THEN k END) OVER (PARTITION BY run_id ORDER BY global_step), 0) AS stale FROM g)
    SELECT run_id, arg_min(global_step, (loss, global_step)) FILTER (NOT isnan(loss)) AS best_step, min(loss) FILTER (NOT isnan(loss)) AS best_loss, min(global_step) FILTER (stale >= 2) AS stop_step FROM s GROUP BY 1""")
def early_stop(spark, d):
    return metrics.early_stops(table(spark, d, "metrics_log"))


@query("""SELECT global_step AS "train/global_step", train_epoch AS "train/epoch", eval_loss AS "eval/loss", CASE WHEN eval_loss < 20 THEN round(exp(eval_loss), 6) ELSE 'inf'::DOUBLE END AS "eval/perplexity" FROM metrics_log WHERE eval_loss IS NOT NULL""")
def metric_rows(spark, d):
    """What is logged of each evaluation."""
    return metrics.metric_rows(table(spark, d, "metrics_log")).withColumn("eval/perplexity", F.round("eval/perplexity", 6))


@query(f"""WITH s AS ({_split_sql("'cry', 'saw', 'txt'", "id, filetype")}), k AS (SELECT sum(length(coalesce(content, '')))::DOUBLE AS c, sum(length(coalesce(content, '')))::DOUBLE AS t, count(*) AS n FROM all_hybrid)
    SELECT 'train_rows' AS name, count(*)::DOUBLE AS value FROM s WHERE split = 'train' UNION ALL SELECT 'test_rows', count(*)::DOUBLE FROM s WHERE split = 'test' UNION ALL SELECT 'rows', n::DOUBLE FROM k
    UNION ALL SELECT 'characters', c FROM k UNION ALL SELECT 'tokens', t FROM k UNION ALL SELECT 'chars_per_token', c / greatest(t, 1) FROM k UNION ALL SELECT 'estimated_windows', greatest(1, ceil(t / 3584)) FROM k""")
def corpus_report(spark, d):
    """The figures that a run of the pipeline reports, as rows."""
    t = corpus(spark, d)
    sizes = split.split_by_filetype(t).groupBy("split").agg(F.count("*").cast("double").alias("value")).select(F.concat("split", F.lit("_rows")).alias("name"), "value")
    counted = t.select(F.length("content").alias("c"), F.size(K.codepoints(F.col("content"))).alias("n"))
    return sizes.unionByName(stats.report(counted, "c", "n", 4096, 0.125))


# --- sinks, pipelines, streams ----------------------------------------------------------------------------


@query(f"SELECT id, md5(content) AS digest, set_name AS \"set\", filetype FROM ({CORPUS_SQL}) WHERE set_name = 'supervised'")
def jsonl_roundtrip(spark, d):
    """The supervised rows written as JSON lines and read again."""
    path = fresh(spark, "jsonl")
    rows = split.of_set(corpus(spark, d), "supervised").select("id", "content", "set", "filetype")
    write_jsonl(rows, path)
    return read_jsonl(spark, path, rows.schema).select("id", F.md5(F.col("content").cast("binary")).alias("digest"), "set", "filetype")


@query("SELECT CASE WHEN set_name = 'supervised' THEN record_id END AS id, CASE WHEN set_name = 'supervised' THEN md5(content) END AS digest FROM all_hybrid WHERE set_name = 'supervised' OR set_name IS NULL")
def jsonl_lenient(spark, d):
    """Lines of which some are blank, which are skipped, and some are cut off, which give rows of nulls unless reading is strict."""
    path = fresh(spark, "lines")
    t = corpus(spark, d)
    line = F.when(F.col("set") == "supervised", F.to_json(F.struct("id", "content"))).when(F.col("set").isNull(), "{").otherwise(F.when(F.col("id") % 2 == 0, "  ").otherwise(""))
    t.select(line.alias("line")).write.text(path)
    return read_jsonl(spark, path, "id bigint, content string", strict=False).select("id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query(f"SELECT s.id, s.split, md5(content) AS digest, s.filetype FROM (SELECT *, row_number() OVER (PARTITION BY id, split) AS k FROM ({_SFT_SQL})) AS s JOIN (SELECT record_id AS id, any_value(content) AS content FROM all_hybrid GROUP BY 1) USING (id)")
def sft_files(spark, d):
    """The supervised split written as two sets of JSON lines, each in its random order, and both read again."""
    rows = corpus(spark, d).select("id", "content", "set", "filetype")
    both = zip(("train", "val"), supervised_files(rows, fresh(spark, "sft")), strict=True)
    train, val = (t.select("id", F.lit(name).alias("split"), F.md5(F.col("content").cast("binary")).alias("digest"), "filetype") for name, t in both)
    return train.unionByName(val)


@query("SELECT * FROM (VALUES ('no rows of the types', true), ('column missing', true), ('nothing to replay', true), ('no budget', true)) AS v(guard, raised)")
def guards(spark, d):
    """What must be refused rather than give an empty or endless result."""

    def raised(f: Callable[[], object]) -> bool:
        try:
            f()
        except ValueError:
            return True
        return False

    t = corpus(spark, d)
    tried = {
        "no rows of the types": lambda: split.split_by_filetype(t, filetypes=("absent",)),
        "column missing": lambda: require_columns(t, ["id", "absent"]),
        "nothing to replay": lambda: replayed(t.where("false").withColumn("ord", F.lit(0)), 2),
        "no budget": lambda: budget(0, 3.6, 1024),
    }
    return local(spark, [(name, raised(f)) for name, f in tried.items()], "guard string, raised boolean")


_MEMORY = [(0, "first text"), (1, ""), (2, None), (3, "é😀" * 300), (4, "last")]
_MEMORY_SQL = "SELECT id, content, id AS ord, length(content) AS units FROM (VALUES (0, 'first text'), (1, ''), (2, NULL), (3, repeat('é😀', 300)), (4, 'last')) AS v(id, content)"


@query(_windows_sql(_MEMORY_SQL, _TOKENS_SQL, 256))
def memory_source(spark, d):
    """Rows that the caller holds are a source like any other."""
    return _digests(examples(with_ordinals(local(spark, _MEMORY, "id bigint, content string"), ["id"]), PACK))


def _pretrain_sql(how: Packer, sequences: int, eval_seed: int, epochs: int = 1, place: str = "") -> str:
    """The whole pipeline: split, order, budget from the first training rows, permutation, buffers, windows."""
    u = uniform_sql(42, "split", "id")
    rows = f"""WITH r AS (SELECT id, content, CASE filetype WHEN 'cry' THEN 0 WHEN 'saw' THEN 1 ELSE 2 END AS kind, {u} AS u, row_number() OVER (PARTITION BY filetype ORDER BY {u}, id) AS rank,
            count(*) OVER (PARTITION BY filetype) AS n FROM ({CORPUS_SQL}) WHERE set_name = 'unsupervised' AND filetype IN ('cry', 'saw', 'txt'))
        SELECT *, row_number() OVER (PARTITION BY split ORDER BY kind, u, id) - 1 AS ord FROM (SELECT id, content, kind, u, {_TOKENS_SQL} AS t, CASE WHEN rank <= ceil(0.1::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r)"""
    most = f"SELECT {how.seq_length * sequences}::DOUBLE * (sum(length(coalesce(content, '')))::DOUBLE / greatest(sum(len(t)), 1)) AS most FROM base WHERE split = 'train' AND ord < 400"
    train = f"SELECT id, t, ord + e * (SELECT count(*) FROM base WHERE split = 'train') AS ord, length(content) AS units FROM base, range(0, {epochs}) AS k(e) WHERE split = 'train'"
    made = f"SELECT id, o AS content, ord, units FROM ({_permuted_sql(train, how.fim_rate, how.fim_spm_rate, seed=how.seed)})"
    first = _windows_sql(made, "content", max(1, int(how.seq_length * (1 - how.overlap_ratio))), size=how.seq_length, most="(SELECT most FROM budget)")
    second = _windows_sql("SELECT id, t AS content, ord, length(content) AS units FROM base WHERE split = 'test'", "content", how.seq_length, size=how.seq_length, most="(SELECT most FROM budget)")
    return f"""WITH base AS MATERIALIZED ({rows}), budget AS MATERIALIZED ({most})
        SELECT *{place}, 'train' AS split FROM ({first}) UNION ALL SELECT *{', NULL::BIGINT AS place' if place else ''}, 'test' AS split FROM ({second})"""


def _pretrained(train: DataFrame, test: DataFrame) -> DataFrame:
    return _digests(train).withColumn("split", F.lit("train")).unionByName(_digests(test).withColumn("split", F.lit("test")))


@query(_pretrain_sql(Packer(4096, fim_rate=0.125, overlap_ratio=0.125, seed=42), 1024, 42 + 4371))
def pretrain_windows(spark, d):
    """The flagship: the whole pretraining pipeline with its own constants; windows of both splits."""
    return _pretrained(*pretrain_corpus(corpus(spark, d)))


@query(_pretrain_sql(Packer(256, fim_rate=0.5, overlap_ratio=0.25, seed=42), 64, 5, 2, ", row_number() OVER (PARTITION BY buf ORDER BY " + uniform_sql(42 + 3000, "bufshuf", "buf", "win") + ", win) - 1 AS place"))
def pretrain_replayed(spark, d):
    """The pipeline with its other options: a content column of another name, two epochs, windows shuffled in their buffers."""
    t = corpus(spark, d).withColumnRenamed("content", "body")
    train, test = pretrain_corpus(t, 256, 64, 0.5, overlap=0.25, content="body", eval_seed=5, shuffle=True, epoch=3, epochs=2)
    train, test = _digests(train, "place"), _digests(test).withColumn("place", F.lit(None).cast("bigint"))
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


#: Files of the stream, each a micro-batch.
FILES = 4


@query(" UNION ALL ".join("SELECT * FROM (" + _windows_sql(f"SELECT record_id AS id, content, row_number() OVER (ORDER BY record_id, ingested_at NULLS FIRST) - 1 AS ord, length(content) AS units FROM all_hybrid WHERE record_id % {FILES} = {k}", _TOKENS_SQL, 256) + ")" for k in range(FILES)))
def stream_pack(spark, d):
    """The corpus as a stream of files, packed a micro-batch at a time."""
    from millrace.streaming.packing import pack_stream, read_stream

    folder = fresh(spark, "stream")
    rows = corpus(spark, d).select("id", "content", "ingested_at")
    rows.repartitionById(FILES, F.pmod("id", F.lit(FILES)).cast("int")).write.parquet(f"{folder}/in")
    stream = read_stream(spark, f"{folder}/in", rows.schema, "parquet", max_files=1)
    pack_stream(stream, f"{folder}/out", f"{folder}/state", PACK, ORDER).awaitTermination()
    return _digests(spark.read.parquet(f"{folder}/out"))
