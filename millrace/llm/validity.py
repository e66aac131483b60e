"""Source files that no dialect of their language accepts, and how many there are by repository and language.

Files are parsed by generalised LL over graph-structured stacks, all dialects of a language in one run; see `gll` and `languages`.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import labels as L
from millrace.llm.languages import LANGUAGES, dialects
from millrace.shared import ship


def checked(records: DataFrame) -> DataFrame:
    """(id, filetype, accepted_by) of each id in `records` (id, filetype, content) whose file type is a language with a grammar.

    `filetype` is taken without letter case, outer blanks and a leading dot. Null and blank contents give no row; rows that repeat an id count once.
    `accepted_by` lists the dialects, in order; it is empty for an invalid file. Further columns are ignored.
    """
    ship(records.sparkSession)
    kind = L.filetype("filetype")
    rows = records.select("id", kind.alias("filetype"), "content").where(F.col("filetype").isin(*LANGUAGES) & F.col("content").rlike(r"(?U)\S"))

    def batches(it):
        for b in it:
            names, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            found = [sorted(dialects(n, t)) for n, t in zip(names, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.string()))], ["id", "filetype", "accepted_by"])

    return rows.mapInArrow(batches, "id bigint, filetype string, accepted_by array<string>").dropDuplicates(["id"])


def rates(files: DataFrame, by: list[str]) -> DataFrame:
    """n_files, n_invalid and invalid_share for each combination of `by` in `files`, rows of `checked` with those columns."""
    bad = F.count_if(F.size("accepted_by") == 0)
    return files.groupBy(*by).agg(F.count("*").alias("n_files"), bad.alias("n_invalid"), (bad / F.count("*")).alias("invalid_share"))
