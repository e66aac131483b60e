"""The two pipelines: packed examples for continued pretraining, and the supervised split."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.tokens import BEYOND, SpecialTokens, Tokenizer, codepoints
from millrace.operators.buffers import assign_buffers, budget
from millrace.operators.fim import permute
from millrace.operators.pack import placed, segments, shuffled_windows, windows
from millrace.operators.split import FILETYPES, sft_split, shuffled, split_in_order
from millrace.operators.stats import ratio_of_counts
from millrace.shared import cut
from millrace.sources.jsonl import read_jsonl, replayed, require_columns, write_jsonl


@dataclass(frozen=True)
class Packer:
    """How documents become examples. `epoch` and `worker` only change the order of shuffled windows; `epochs` replays the source."""

    seq_length: int = 1024
    num_of_sequences: int = 1024
    chars_per_token: float = 3.6
    content_field: str = "content"
    fim_rate: float = 0.5
    fim_spm_rate: float = 0.5
    seed: int = 0
    already_tokenized: bool = False
    overlap_ratio: float = 0.0
    shuffle: bool = False
    epoch: int = 0
    worker: int = 0
    epochs: int = 1
    special: SpecialTokens = BEYOND
    tokenizer: Tokenizer = codepoints


def _units(content: Column, how: Packer) -> Column:
    return F.coalesce(F.size(content) if how.already_tokenized else F.length(content), F.lit(0)).cast("bigint")


def _tokenised(df: DataFrame, how: Packer) -> DataFrame:
    """`df` with `units` and `tokens` instead of its content. The tokenizer stands in the plan once, whatever reads its tokens."""
    content = F.col(how.content_field)
    tokens = content if how.already_tokenized else how.tokenizer(content)
    return df.select(*[c for c in df.columns if c != how.content_field], _units(content, how).alias("units"), tokens.alias("tokens"))


def placed_segments(df: DataFrame, how: Packer, key: str = "id") -> DataFrame:
    """Rows (key, content, ord, part) to their places in the streams of their buffers."""
    rows = df.select(key, "ord", "part", how.content_field)
    if how.epochs > 1:
        last = df.agg(F.max("part").alias("m")).first()["m"] or 0
        rows = replayed(rows, how.epochs, parts=last + 1)
    made = _tokenised(rows, how).withColumn("tokens", permute(F.col("tokens"), key, how.special, how.fim_rate, how.fim_spm_rate, how.seed))
    return _in_buffers(cut(segments(made, how.special), "segments"), how)


def _in_buffers(written: DataFrame, how: Packer, stream: str | None = None) -> DataFrame:
    """Written rows of `segments` with units, ord and part to those of `offsets`."""
    return placed(assign_buffers(written, budget(how.seq_length, how.chars_per_token, how.num_of_sequences), "units", stream=stream), stream)


def _windowed(streams: DataFrame, how: Packer) -> DataFrame:
    made = windows(streams, how.seq_length, how.special, how.overlap_ratio)
    return shuffled_windows(made, how.seed, how.epoch, how.worker) if how.shuffle else made


def examples(df: DataFrame, how: Packer, key: str = "id") -> DataFrame:
    """Constant-length examples (buf, win, input_ids, labels) of rows (key, content, ord, part)."""
    return _windowed(placed_segments(df, how, key), how)


def pretrain_corpus(
    corpus: DataFrame, seq_length: int = 4096, sequences: int = 1024, fim_rate: float = 0.125, fim_spm_rate: float = 0.5, overlap: float = 0.125, seed: int = 42, tokenizer: Tokenizer = codepoints,
    special: SpecialTokens = BEYOND, test_size: float = 0.10, sample: int = 400, filetypes: tuple[str, ...] = FILETYPES, content: str = "content", eval_seed: int | None = None,
    already_tokenized: bool = False, shuffle: bool = False, epoch: int = 0, epochs: int = 1, chars_per_token: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(training examples, evaluation examples) of a corpus (id, content, set, filetype).

    Split by file type; characters per token from the first `sample` training rows, or as given, set the budget of a buffer; training examples are
    permuted and overlap, evaluation examples are neither. `content` names the column of texts, or of token lists if `already_tokenized`
    (then the budget counts tokens and the ratio is 1 unless given). `shuffle` gives training windows a `place` within their buffer that changes with
    `epoch`; `epochs` replays the training rows. `eval_seed` is the seed of the evaluation examples, otherwise seed + 4371.
    Documents are read, tokenised, permuted and written once, in their order; later steps read lengths until windows are cut.
    """
    how = Packer(seq_length, sequences, 1.0, content, fim_rate, fim_spm_rate, seed, already_tokenized, overlap, shuffle, epoch, epochs=epochs, special=special, tokenizer=tokenizer)
    later = replace(how, fim_rate=0.0, overlap_ratio=0.0, seed=seed + 4371 if eval_seed is None else eval_seed, shuffle=False, epochs=1)
    rows = require_columns(corpus, ["id", content, "set", "filetype"]).select("id", content, "set", "filetype")

    def made(d: DataFrame) -> DataFrame:
        tokens = _tokenised(d.select("id", "split", "place", "split_draw", "_at", content), how)
        permuted = permute(F.col("tokens"), "id", special, fim_rate, fim_spm_rate, seed)
        tokens = tokens.withColumn("n_plain", F.coalesce(F.size("tokens"), F.lit(0))).withColumn("tokens", F.when(F.col("split") == "train", permuted).otherwise(F.col("tokens")))
        return segments(tokens, special, order="_at", part=F.shiftright("_at", 33))

    both = split_in_order(rows, made, seed=seed, test_size=test_size, filetypes=filetypes)
    train, test = (F.col("split") == s for s in ("train", "test"))
    ratio = chars_per_token
    if ratio is None:
        ratio = 1.0 if already_tokenized else ratio_of_counts(both.where(train & (F.col("ord") < sample)), "units", "n_plain").first()["ratio"]
    how, later = replace(how, chars_per_token=ratio), replace(later, chars_per_token=ratio)
    if epochs > 1:
        parts = (both.agg(F.max("part").alias("m")).first()["m"] or 0) + 1
        again = replayed(both.where(train), epochs, parts=parts).withColumn("at", F.struct((F.col("at.run") + F.shiftleft(F.col("epoch") * F.lit(parts).cast("bigint"), 33)).alias("run"), F.col("at.before").alias("before")))
        both = both.where(test).unionByName(again.drop("epoch"))
    streams = _in_buffers(both, how, "split")
    return _windowed(streams.where(train), how), _windowed(streams.where(test), later)


def sft_corpus(corpus: DataFrame, seed: int = 4371, train_size: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(training rows, validation rows) of the supervised set, each in a random order `ord`."""
    split = sft_split(corpus, seed=seed, train_size=train_size)
    both = cut(shuffled(split, seed=seed, group="split"), "sft")
    return both.where(F.col("split") == "train").drop("split"), both.where(F.col("split") == "val").drop("split")


def sft_files(corpus: DataFrame, folder: str, seed: int = 4371, train_size: float = 0.95, files: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`sft_corpus` written as JSON lines to folder/train and folder/val, in order within each file, and both read again, without `ord`."""
    kept = [c for c in corpus.columns if c != "ord"]
    for name, rows in zip(("train", "val"), sft_corpus(corpus, seed, train_size), strict=True):
        ordered = rows.coalesce(files) if files else rows
        write_jsonl(ordered.sortWithinPartitions("ord").select(*kept), f"{folder}/{name}")
    return tuple(read_jsonl(corpus.sparkSession, f"{folder}/{name}", corpus.select(*kept).schema) for name in ("train", "val"))
