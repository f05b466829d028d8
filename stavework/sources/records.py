"""Text records as columns: comments stripped, fields typed, rejects kept with their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stavework.operators.ordered import with_position
from stavework.operators.truth import REST_LABELS, RIFF_LABELS, VERDICTS


def truth_lines(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line, record): one row per line that still holds something without its comment."""
    lines = texts.select(*keys, F.posexplode(F.split(text, r"\r?\n")).alias("n", "raw"))
    record = F.regexp_replace(F.regexp_replace("raw", r"(^|(?<=\s))#.*", ""), r"^\s+|\s+$", "")
    return lines.select(*keys, (F.col("n") + 1).alias("line"), record.alias("record")).where("record <> ''")


def _range(f: Column) -> tuple[Column, Column, Column]:
    start, end = F.get(f, F.lit(0)).try_cast("int"), F.get(f, F.lit(1)).try_cast("int")
    bad = F.when(start.isNull() | end.isNull(), "expected start and end bar numbers").when((start < 0) | (end <= start), "expected 0 <= start < end")
    return start, end, bad


def read_patterns(lines: DataFrame) -> DataFrame:
    """`start end verdict [figure [figure]]`, with `reject` naming what is wrong."""
    f = F.split("record", r"\s+")
    start, end, bad = _range(f)
    verdict, figure = F.get(f, F.lit(2)), F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0)))
    reject = (
        F.when(~F.size(f).between(3, 5), "expected 'start end verdict [figure]'").when(bad.isNotNull(), bad)
        .when(~verdict.isin(*VERDICTS), "expected a verdict YES, MOSTLY or NO")
        .when(F.exists(figure, lambda x: ~F.regexp_like(x, F.lit(r"^[DUx-]+$"))), "expected a figure of D, U, x and -")
    )
    return lines.select("*", start.alias("start"), end.alias("end"), verdict.alias("verdict"),
                        F.when(F.size(figure) > 0, figure).alias("figure"), reject.alias("reject"))


def read_labels(lines: DataFrame) -> DataFrame:
    """`start end label` over the riff and rest labels."""
    f = F.split("record", r"\s+")
    start, end, bad = _range(f)
    label = F.get(f, F.lit(2))
    reject = F.when(F.size(f) != 3, "expected 'start end label'").when(bad.isNotNull(), bad).when(
        ~label.isin(*RIFF_LABELS, *REST_LABELS), "expected a label")
    return lines.select("*", start.alias("start"), end.alias("end"), label.alias("label"), reject.alias("reject"))


def read_keys(lines: DataFrame, keys: list[str]) -> DataFrame:
    """`tonic mode source`, at most two lines per file; `place` numbers a file's lines, however many there are."""
    f = F.split("record", r"\s+")
    tonic, mode = F.get(f, F.lit(0)), F.get(f, F.lit(1))
    reject = (
        F.when(F.size(f) != 3, "expected 'tonic mode source'").when(F.col("place") > 2, "expected at most two key lines")
        .when(~F.regexp_like(tonic, F.lit(r"^[A-Ga-g][#b]?$")), "not a key").when(~mode.isin("major", "minor"), "not a key: mode is not major or minor")
    )
    placed = with_position(lines, keys, ["line"], None, "place").withColumn("place", (F.col("place") + 1).cast("int"))
    return placed.select("*", tonic.alias("tonic"), mode.alias("mode"), reject.alias("reject"))


def read_credits(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The title on a file's first record line, the artist on its second, nothing after."""
    first_three = lines.groupBy(*keys).agg(
        F.min_by("record", "line").alias("title"), F.count("*").alias("n"), F.min("line").alias("first_line"))
    second = lines.join(first_three.select(*keys, "first_line"), keys).where("line > first_line").groupBy(*keys).agg(F.min_by("record", "line").alias("artist"))
    return first_three.join(second, keys, "left").select(
        *keys, "title", "artist", F.when(F.col("n") < 2, "expected the artist on a second line").when(F.col("n") > 2, "expected only a title line and an artist line").alias("reject"))


def read_spans(lines: DataFrame, strict: bool = True) -> DataFrame:
    """`start end label`, tab separated when the line holds a tab. Rejects are null-checked rows with
    `reject`; a model's own output (`strict` off) just drops them."""
    f = F.when(F.contains("record", F.lit("\t")), F.split("record", "\t")).otherwise(F.split("record", r"\s+"))
    start, end = F.get(f, F.lit(0)).try_cast("double"), F.get(f, F.lit(1)).try_cast("double")
    reject = F.when(F.size(f) < 3, "expected 'start end label' (tab-separated)").when(start.isNull() | end.isNull(), "expected start and end times in seconds")
    out = lines.select("*", start.alias("start"), end.alias("end"), F.trim(F.get(f, F.lit(2))).alias("label"), reject.alias("reject"))
    return out if strict else out.where("reject is null").drop("reject")


def read_beats(lines: DataFrame) -> DataFrame:
    """A beat time per line; a second column of 1 marks a downbeat."""
    f = F.split("record", r"\s+")
    t = F.get(f, F.lit(0)).try_cast("double")
    return lines.select("*", t.alias("t"), F.coalesce(F.get(f, F.lit(1)) == "1", F.lit(False)).alias("is_downbeat"),
                        F.when(t.isNull(), "expected a beat time in seconds").alias("reject"))


def meter(text: Column) -> Column:
    """struct(numerator, denominator) of "4/4"; null when it is not one."""
    n = F.regexp_extract(text, r"^\s*(\d+)/(\d+)\s*$", 1).try_cast("int")
    d = F.regexp_extract(text, r"^\s*(\d+)/(\d+)\s*$", 2).try_cast("int")
    return F.when(n.isNotNull() & d.isNotNull(), F.struct(n.alias("numerator"), d.alias("denominator")))


def beat_file_line(t: Column, index: Column, position: Column) -> Column:
    return F.format_string("%.4f\t%d\t%d", t, index, position)


def onset_label_line(t: Column, muted: Column, added: Column) -> Column:
    label = F.concat(F.when(muted, "x").otherwise("S"), F.when(added, "+").otherwise(""))
    return F.concat(F.format_string("%.3f\t%.3f\t", t, t), label)
