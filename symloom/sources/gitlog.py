"""Reader of ``git log`` text: header lines of four fields and the files below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separates sha, date, author and subject in a header.
FIELD = "\x1f"
#: What produces such a text.
COMMAND = ("git", "log", "-500", "--no-merges", f"--pretty=format:%H{FIELD}%aI{FIELD}%ae{FIELD}%s", "--name-only")


def parse_git_log(logs: DataFrame, text: Column | str = "value") -> DataFrame:
    """(sha, date, message, author_email, files) of log texts, one log in each row.

    Blank lines separate commits.  Blocks whose first line has fewer than four
    fields are left out; a separator in the subject belongs to the subject.
    """
    whole = F.replace(F.col(text) if isinstance(text, str) else text, F.lit("\r\n"), F.lit("\n"))
    blocks = logs.select(F.explode(F.split(F.regexp_replace(whole, r"\n+\z", ""), "\n\n")).alias("block"))
    lines = blocks.select(F.split("block", "\n").alias("lines")).select(F.split(F.get("lines", F.lit(0)), FIELD).alias("head"), "lines")
    files = F.array_sort(F.filter(F.transform(F.slice("lines", 2, F.size("lines")), lambda f: F.btrim(f, F.lit(" \t\r"))), lambda f: f != ""))
    head = F.col("head")
    return lines.where(F.size(head) >= 4).select(
        head[0].alias("sha"), head[1].alias("date"), F.array_join(F.slice(head, 4, F.size(head)), FIELD).alias("message"), head[2].alias("author_email"), files.alias("files"),
    )
