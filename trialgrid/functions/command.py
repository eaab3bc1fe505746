"""Option tokens (F12) and the encoder command line of a trial."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The head of every encoder command and the flags it is built
# from, in order.
COMMAND_HEAD = ["ffmpeg", "-y", "-threads"]
INPUT_FLAG = "-i"
CODEC_FLAG = "-c:v"
PRESET_FLAG = "-preset:v"
NO_PRESET = "none"
OUTPUT_SUFFIX = ".mkv"


def option_tokens(text) -> Column:
    """Split on runs of whitespace with no empty tokens (`"  -a  1 "` -> [-a, 1])."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")


def _when_not_empty(value: Column, tokens: Column) -> Column:
    return F.when(value != "", tokens).otherwise(F.array().cast("array<string>"))


def command_tokens(trial_threads: Column, hwaccels: Column, infile_option: Column,
                   infile_filename: Column, outfile_options: Column, codec: Column,
                   preset: Column, outfile_filename: Column) -> Column:
    """Token array: head, hwaccels if set, input option if set, `-i file`,
    output options, `-c:v codec`, `-preset:v p` unless preset is "none", output file."""
    return F.concat(
        F.array(*[F.lit(t) for t in COMMAND_HEAD], trial_threads),
        _when_not_empty(hwaccels, option_tokens(hwaccels)),
        _when_not_empty(infile_option, option_tokens(infile_option)),
        F.array(F.lit(INPUT_FLAG), infile_filename),
        option_tokens(outfile_options),
        F.array(F.lit(CODEC_FLAG), codec),
        F.when(preset != NO_PRESET, F.array(F.lit(PRESET_FLAG), preset))
         .otherwise(F.array().cast("array<string>")),
        F.array(F.concat(outfile_filename, F.lit(OUTPUT_SUFFIX))),
    )


def command_line() -> Column:
    """Command text of a flat trial row (joined with one space)."""
    return F.array_join(command_tokens(
        F.col("threads"), F.col("hwaccels"), F.col("infile_option"), F.col("infile_filename"),
        F.col("outfile_options"), F.col("codec"), F.col("preset"), F.col("outfile_filename")), " ")
