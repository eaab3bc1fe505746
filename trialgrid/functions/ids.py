"""Content-hash ids of trials (F9) and output paths.

The option hash is SHA-256 of the text of a two-item Python list,
``['{codec}{type}{preset}{option}', '{threads}{hwaccels}{infile_option}']``;
the trial id is SHA-256 of ``basefile + basehash + option hash``. The list
text is only byte-exact while no value holds a quote, a backslash or a control
character (Python would switch quotes or escape), so such values are refused
at run time instead of being guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that make Python's list text differ from plain quoting.
_UNSAFE = r"['\\\x00-\x1f\x7f]"


def _checked(c: Column, what: str) -> Column:
    return F.when(c.rlike(_UNSAFE), F.raise_error(F.concat(F.lit(f"unsafe {what} for trial id: "), c))
                  ).otherwise(c)


def option_hash(codec: Column, type_: Column, preset: Column, option: Column,
                threads: Column, hwaccels: Column, infile_option: Column,
                checked: bool = True) -> Column:
    """`checked=False` when the inputs were already validated upstream (see
    `unsafe_text`), e.g. once per pattern instead of once per grid cell."""
    first = F.concat(codec, type_, preset, option)
    second = F.concat(threads, hwaccels, infile_option)
    if checked:
        first, second = _checked(first, "option part"), _checked(second, "input part")
    text = F.concat(F.lit("['"), first, F.lit("', '"), second, F.lit("']"))
    return F.sha2(text, 256)


def unsafe_text(*cols: Column) -> Column:
    """True when any string (or any element of a string array) would make the
    id text differ from plain quoting."""
    tests = []
    for c in cols:
        tests.append(F.coalesce(c.rlike(_UNSAFE), F.lit(False)))
    return F.greatest(*tests) if len(tests) > 1 else tests[0]


def unsafe_in_array(arr: Column) -> Column:
    return F.coalesce(F.exists(arr, lambda x: x.rlike(_UNSAFE)), F.lit(False))


def trial_id(basefile: Column, basehash: Column, id_opt: Column) -> Column:
    return F.sha2(F.concat(basefile, basehash, id_opt), 256)


def output_path(distdir: Column, tid: Column) -> Column:
    """`{distdir}/{first 12 hex digits of the id}`."""
    return F.concat(distdir, F.lit("/"), F.substring(tid, 1, 12))


def distdir_of(config_file: Column) -> Column:
    """`./videos/dist/<config file name without .yml>`."""
    name = F.element_at(F.split(config_file, "/"), -1)
    return F.concat(F.lit("./videos/dist/"), F.replace(name, F.lit(".yml"), F.lit("")))
