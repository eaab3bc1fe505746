"""DuckDB oracle SQL for every registered query (same tables, same names).

Written from the fixture definitions, not generated from the Spark plans.
Literals are cast to DOUBLE (an untyped `1.5` is DECIMAL in DuckDB), and
double outputs are rounded to 6 places as in the catalog.
"""

from __future__ import annotations


def _hms(x: str) -> str:
    s = f"CAST(floor({x}) AS BIGINT)"
    return f"printf('%02d:%02d:%02d', ({s} // 3600) % 24, ({s} % 3600) // 60, {s} % 60)"


def _fmt_seconds(s: str) -> str:
    return f"printf('%02dd, %02dh%02dm%02ds', ({s}) // 86400, (({s}) % 86400) // 3600, (({s}) % 3600) // 60, ({s}) % 60)"


def D(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def NR(expr: str, digits: int) -> str:
    """The engine's own ROUND, on the decimal text of the double."""
    return f"CAST(ROUND(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


def SUMX(expr: str) -> str:
    """Exact sum in units of 2^-78: whole numbers, rounded once at the end."""
    units = f"SUM(CAST(trunc(CAST({expr} AS DOUBLE) * {D(2 ** 78)}) AS HUGEINT))"
    return f"(CAST(CAST({units} AS VARCHAR) AS DOUBLE) / {D(2 ** 78)})"


def AVGX(expr: str) -> str:
    return f"({SUMX(expr)} / COUNT({expr}))"


def R(expr: str, alias: str, digits: int = 6) -> str:
    return f'{NR(expr, digits)} AS "{alias}"'


KEYTEXT = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"

TRIALS = f"""
trials AS (
  SELECT
    sha256({KEYTEXT}) AS id,
    sha256('[''' || p_type || l_returnflag || 'medium' || '-q ' || CAST(l_linenumber AS VARCHAR)
           || ''', ''' || '4' || ''']') AS id_opt,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_discount, l_extendedprice, l_tax,
    p_type AS codec, l_returnflag AS type, p_name AS comments, 'medium' AS preset, '4' AS threads,
    p_brand AS ref_name, l_linestatus AS ref_type, '' AS infile_option,
    'clips/o' || CAST(l_orderkey AS VARCHAR) || '.m2ts' AS infile_filename,
    't/' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS outfile_filename,
    '-q ' || CAST(l_linenumber AS VARCHAR) AS outfile_options,
    CASE WHEN l_quantity < {D(5)} THEN '' ELSE sha256({KEYTEXT}) END AS outfile_hash,
    l_extendedprice / {D(15)} AS outfile_bit_rate_kbs,
    l_extendedprice AS outfile_size_kbyte,
    CAST(p_size AS BIGINT) AS gop,
    CAST(l_linenumber % 6 AS BIGINT) AS has_b_frames,
    CAST(1 + l_suppkey % 8 AS BIGINT) AS refs,
    CAST(l_linenumber AS BIGINT) AS fI,
    CAST(l_quantity AS BIGINT) AS fP,
    CAST(p_size AS BIGINT) AS fB,
    CAST(l_linenumber AS BIGINT) + CAST(l_quantity AS BIGINT) + CAST(p_size AS BIGINT) AS fT,
    l_quantity AS enc_sec,
    {_hms('l_quantity')} AS enc_time,
    {D(1)} - l_discount * CAST(2 + (CASE WHEN l_linestatus = 'F' THEN 2 ELSE 1 END) * l_linenumber AS DOUBLE)
      AS comp_ratio_persent,
    {D(120)} / l_quantity AS enc_speed,
    {D(1)} - l_tax AS ssim_min,
    {D(1)} - l_tax / {D(5)} AS ssim_mean,
    {D(60)} + l_quantity / {D(2)} AS vmaf_min,
    {D(90)} + {D(1.5)} * CAST(l_linenumber AS DOUBLE) AS vmaf_mean,
    l_tax * {D(100)} AS probe_sec,
    l_discount * {D(1000)} AS vmaf_sec,
    {D(120)} AS infile_duration, p_retailprice * {D(100)} AS infile_size_kbyte, {D(120)} AS outfile_duration,
    '' AS commandline, '' AS hwaccels,
    CAST(CAST(l_linenumber AS BIGINT) + CAST(l_quantity AS BIGINT) + CAST(p_size AS BIGINT) AS DOUBLE) / l_quantity AS enc_fps,
    {_hms('(l_tax * 100.0::DOUBLE)')} AS probe_time, {_hms('(l_discount * 1000.0::DOUBLE)')} AS vmaf_time,
    '2.3.1' AS vmaf_version, '' AS vmaf_commandline,
    {D(1)} AS ssim_max, {D(1)} - l_tax / {D(10)} AS ssim_amean,
    {D(100)} AS vmaf_max, {D(91)} + {D(1.5)} * CAST(l_linenumber AS DOUBLE) AS vmaf_amean
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""

FLAT_COLS = ["codec", "type", "preset", "threads", "gop", "has_b_frames", "refs", "fI", "fP", "fB", "fT",
             "ref_name", "ref_type", "infile_option", "outfile_filename", "outfile_size_kbyte",
             "outfile_bit_rate_kbs", "outfile_options", "enc_sec", "enc_time", "comp_ratio_persent",
             "enc_speed", "ssim_min", "ssim_mean", "vmaf_min", "vmaf_mean"]
DOUBLES = {"outfile_size_kbyte", "outfile_bit_rate_kbs", "enc_sec", "comp_ratio_persent", "enc_speed",
           "ssim_min", "ssim_mean", "vmaf_min", "vmaf_mean"}
RECORD_DOUBLES = DOUBLES | {"infile_duration", "infile_size_kbyte", "outfile_duration", "enc_fps", "probe_sec", "vmaf_sec",
                            "ssim_max", "ssim_amean", "vmaf_max", "vmaf_amean"}
RECORD_COLS = ["id", "id_opt", "comments", "infile_filename", "infile_duration", "infile_size_kbyte", "outfile_hash",
               "outfile_duration", "commandline", "hwaccels", "enc_fps", "probe_sec", "probe_time", "vmaf_sec", "vmaf_time",
               "vmaf_version", "vmaf_commandline", "ssim_max", "ssim_amean", "vmaf_max", "vmaf_amean", *FLAT_COLS]
MAXC = ["gop", "has_b_frames", "refs", "fI", "fP", "fB", "fT"]
AVGC = ["outfile_size_kbyte", "outfile_bit_rate_kbs", "enc_sec", "comp_ratio_persent", "enc_speed",
        "ssim_min", "ssim_mean", "vmaf_min", "vmaf_mean"]
TYPE_KEYS = ["codec", "type", "preset", "threads", "ref_type", "outfile_options"]
OPTION_KEYS = ["codec", "type", "preset", "threads", "outfile_options"]


def _grouped(keys: list[str]) -> str:
    return (f"SELECT {', '.join(keys)}, " + ", ".join(f"MAX({c}) AS {c}" for c in MAXC) + ", "
            + ", ".join(f"{AVGX(c)} AS {c}" for c in AVGC) + f" FROM trials GROUP BY {', '.join(keys)}")


TR = f"tr AS ({_grouped(TYPE_KEYS)})"


def _sel(cols, src_doubles=DOUBLES) -> str:
    return ", ".join(R(c, c) if c in src_doubles else c for c in cols)


def _report(keys) -> str:
    cols = keys + MAXC + AVGC
    return (f"WITH {TRIALS}, g AS ({_grouped(keys)}) SELECT row_number() OVER (ORDER BY "
            f"{', '.join(keys)}) - 1 AS index, {_sel(cols)} FROM g")


GATE = (f"comp_ratio_persent >= {D(0.6)} AND ssim_mean >= {D(0.99)} AND vmaf_mean >= {D(93)} "
        f"AND vmaf_mean <= {D(100)}")
SUM_AVGS = ["outfile_size_kbyte", "outfile_bit_rate_kbs", "enc_sec", "comp_ratio_persent", "ssim_mean",
            "vmaf_min", "vmaf_mean"]


def _r3(x):
    return NR(AVGX(x), 3)


SUMMARY_BY_CODEC = f"""WITH {TRIALS}, {TR}
SELECT codec, {', '.join(f'{_r3(c)} AS {c}' for c in SUM_AVGS)},
  {NR(AVGX(f"(({D(200)} - (vmaf_min + vmaf_mean)) + ({D(2)} - (ssim_mean + comp_ratio_persent)))"), 3)} AS pt,
  {_r3('gop')} AS gop,
  CASE WHEN AVG(has_b_frames) > {D(1)} THEN {NR(f"AVG(has_b_frames) + {D(1)}", 3)} ELSE {D(0)} END AS bf,
  {_r3('refs')} AS refs,
  CONCAT(CAST({_r3('fI')} AS VARCHAR), ' / ', CAST({_r3('fP')} AS VARCHAR), ' / ',
         CAST({_r3('fB')} AS VARCHAR)) AS "I/P/B frames",
  outfile_options
FROM tr WHERE {GATE}
GROUP BY codec, outfile_options"""

SUMMARY_BY_REF = f"""WITH {TRIALS}, {TR}
SELECT ref_type, {', '.join(f'{_r3(c)} AS {c}' for c in SUM_AVGS)}, outfile_options
FROM tr GROUP BY ref_type, outfile_options
ORDER BY outfile_options DESC, ref_type LIMIT 8"""

RAW_GATE = GATE
AVG_OF_AVG = f"""WITH {TRIALS}, {TR},
two AS (SELECT codec, outfile_options, {_r3('outfile_size_kbyte')} AS two_level_size_kbyte,
               COUNT(*) AS ref_types_passed FROM tr WHERE {GATE} GROUP BY codec, outfile_options),
one AS (SELECT codec, outfile_options, {_r3('outfile_size_kbyte')} AS one_level_size_kbyte,
               COUNT(*) AS trials_passed FROM trials WHERE {RAW_GATE} GROUP BY codec, outfile_options)
SELECT COALESCE(two.codec, one.codec) AS codec, COALESCE(two.outfile_options, one.outfile_options) AS outfile_options,
       two_level_size_kbyte, ref_types_passed, one_level_size_kbyte, trials_passed
FROM two FULL OUTER JOIN one ON two.codec = one.codec AND two.outfile_options = one.outfile_options"""

QUALITY_GATE = f"""WITH {TRIALS}, {TR}
SELECT {_sel(TYPE_KEYS + MAXC + AVGC)} FROM tr WHERE {GATE}"""

SCORE = f"""WITH {TRIALS}, {TR}
SELECT {', '.join(TYPE_KEYS)},
  {R(f'({D(200)} - (vmaf_min + vmaf_mean)) + ({D(2)} - (ssim_mean + comp_ratio_persent))', 'pt')}
FROM tr"""

# --- chart -------------------------------------------------------------------------
CHART_COLS = [
    ("codec", "codec"), ("type", "type"), ("preset", "preset"), ("threads", "threads"),
    ("ref_name", "ref_name"), ("ref_type", "ref_type"), ("infile_option", "infile_option"),
    ("outfile_filename", "outfile_filename"),
    ("outfile_size_kbyte", f"outfile_size_kbyte / {D(1000)}"),
    ("outfile_bit_rate_kbs", f"outfile_bit_rate_kbs / {D(1000)}"),
    ("outfile_options", "outfile_options"), ("stream_gop", "gop"),
    ("stream_has_b_frames", "has_b_frames"), ("stream_refs", "refs"), ("stream_frames_i", "fI"),
    ("stream_frames_p", "fP"), ("stream_frames_b", "fB"), ("enc_sec", "enc_sec"),
    ("enc_time", "enc_time"), ("comp_ratio_persent", "comp_ratio_persent"), ("enc_speed", "enc_speed"),
    ("ssim_min", "ssim_min"), ("ssim_mean", "ssim_mean"), ("vmaf_min", "vmaf_min"),
    ("vmaf_mean", "vmaf_mean"),
]
CHART_DOUBLES = DOUBLES
ROWS = "rows AS (SELECT id, " + ", ".join(f"{src} AS {n}" for n, src in CHART_COLS) + " FROM trials)"
SEL_CODECS = "('PROMO', 'STANDARD')"
MEANS = ["outfile_bit_rate_kbs", "outfile_size_kbyte", "vmaf_mean", "vmaf_min", "stream_gop",
         "stream_has_b_frames", "stream_refs"]
MAXES = ["stream_frames_i", "stream_frames_p", "stream_frames_b"]
GROUPS = (f"grp AS (SELECT codec, ref_type, " + ", ".join(f"{AVGX(c)} AS {c}" for c in MEANS) + ", "
          + ", ".join(f"MAX({c}) AS {c}" for c in MAXES)
          + f", concat_ws('_', codec, ref_type) AS \"group\" FROM rows WHERE "
            f"codec IS NOT NULL AND ref_type IS NOT NULL GROUP BY codec, ref_type)")
CHART_GROUPS = (f"WITH {TRIALS}, {ROWS}, {GROUPS} SELECT codec, ref_type, "
                + ", ".join(R(c, c) for c in MEANS) + ", " + ", ".join(MAXES) + ', "group" FROM grp')
CHART_FEED = (f"WITH {TRIALS}, {ROWS}, {GROUPS} SELECT \"group\", "
              + ", ".join(R(c, c) for c in MEANS) + ", " + ", ".join(MAXES) + " FROM grp")

# --- grid --------------------------------------------------------------------------


def _patterns(previous: bool) -> str:
    presets = "['medium', 'veryslow']" if previous else "CASE WHEN p_size > 25 THEN ['slow', 'medium'] ELSE ['medium'] END"
    first = "'-crf 23 -tag p' || CAST(p_partkey AS VARCHAR)"
    second = "'-crf 28 -tag p' || CAST(p_partkey AS VARCHAR)"
    options = f"[{first}]" if previous else f"[{first}, {second}]"
    return f"""SELECT r_name AS config, p_partkey AS pattern_no, p_type AS codec, p_brand AS type,
        p_name AS comments, {presets} AS presets, {options} AS options
      FROM shipped JOIN part ON l_partkey = p_partkey JOIN region ON n_regionkey = r_regionkey"""


def _grid(name: str, previous: bool) -> str:
    return f"""{name}_p AS ({_patterns(previous)}),
{name}_p1 AS (SELECT config, pattern_no, codec, type, options, UNNEST(presets) AS preset,
                 generate_subscripts(presets, 1) - 1 AS preset_no FROM {name}_p),
{name}_p2 AS (SELECT config, pattern_no, codec, type, preset, preset_no, UNNEST(options) AS out_option,
                 generate_subscripts(options, 1) - 1 AS option_no FROM {name}_p1),
{name}_c AS (SELECT x.*, refs.ref_no, refs.ref_name, refs.basefile, refs.basehash,
               sha256('[''' || codec || type || preset || out_option || ''', ''' || '4' || ''']') AS id_opt
             FROM {name}_p2 x JOIN refs ON x.config = refs.config),
{name} AS (SELECT *, sha256(basefile || basehash || id_opt) AS id,
              './videos/dist/' || config || '/' || substr(sha256(basefile || basehash || id_opt), 1, 12)
                AS outfile_filename FROM {name}_c)"""


GRID_BASE = """shipped AS (SELECT DISTINCT l_partkey, n_regionkey FROM lineitem
    JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
refs AS (SELECT r_name AS config, CAST(n_nationkey AS BIGINT) AS ref_no, n_name AS ref_name,
    CASE WHEN n_nationkey % 2 = 0 THEN 'Anime' ELSE 'Nature' END AS ref_type,
    './videos/source/' || n_name || '.m2ts' AS basefile, sha256(n_name) AS basehash
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""

GRID_COLS = ("config, pattern_no, CAST(preset_no AS BIGINT) AS preset_no, CAST(option_no AS BIGINT) AS option_no, "
             "ref_no, id, id_opt, codec, type, preset, out_option, ref_name, outfile_filename")

PARAM_GRID = f"WITH {GRID_BASE}, {_grid('g', False)} SELECT {GRID_COLS} FROM g"
NEW_TRIALS = (f"WITH {GRID_BASE}, {_grid('g', False)}, {_grid('old', True)} SELECT {GRID_COLS} FROM g "
              f"WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = g.id)")
_ORD = "config, pattern_no, CAST(preset_no AS BIGINT) AS preset_no, CAST(option_no AS BIGINT) AS option_no, ref_no"
APPEND_TRIALS = (f"WITH {GRID_BASE}, {_grid('g', False)}, {_grid('old', True)} "
                 f"SELECT 0 AS src, id, {_ORD} FROM old UNION ALL "
                 f"SELECT 1 AS src, id, {_ORD} FROM g WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = g.id)")
TRIAL_IDS = (f"WITH {GRID_BASE}, {_grid('g', False)} SELECT config, pattern_no, CAST(preset_no AS BIGINT) AS preset_no, "
             f"CAST(option_no AS BIGINT) AS option_no, ref_no, id_opt, id, outfile_filename FROM g")
PATTERN_FILTER = (f"WITH {GRID_BASE}, p AS ({_patterns(False)}) SELECT config, pattern_no, codec, type, comments, "
                  f"array_to_string(presets, '|') AS presets, array_to_string(options, '|') AS options "
                  f"FROM p WHERE codec = 'PROMO'")
SEQUENCE_GRID = """SELECT p_partkey, i AS qp_i, p AS qp_p, b AS qp_b,
  printf('%s -min_qp_i %d -min_qp_p %d -min_qp_b %d', prefix, i, p, b) AS option
FROM (SELECT p_partkey, '-c:v ' || p_type || ' -tag p' || CAST(p_partkey AS VARCHAR) AS prefix FROM part) x,
  range(25, 39, 1) t1(i), range(25, 39, 3) t2(p), range(25, 39, 3) t3(b)"""

LATEST_BY_ID = f"""WITH {TRIALS}
SELECT id_opt AS id, l_orderkey, l_linenumber, l_partkey, l_suppkey, outfile_size_kbyte AS size
FROM (SELECT *, row_number() OVER (PARTITION BY id_opt ORDER BY l_shipdate DESC, l_orderkey DESC,
        l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM trials) WHERE rn = 1"""

PROGRESS_ETA = f"""WITH {TRIALS},
l AS (SELECT id, enc_sec + probe_sec + vmaf_sec AS lap,
             row_number() OVER (ORDER BY id, enc_sec + probe_sec + vmaf_sec) - 1 AS idx FROM trials),
n AS (SELECT COUNT(*) AS n FROM trials),
p AS (SELECT idx, id, COALESCE(LAG(lap) OVER (ORDER BY idx), {D(0)}) AS lap FROM l)
SELECT idx AS index, id, printf('%04d/%04d', idx + 1, n) AS position,
  {R(f'CAST(idx + 1 AS DOUBLE) / CAST(n AS DOUBLE)', 'fraction')},
  CAST(floor(lap) AS BIGINT) AS lap_seconds, {_fmt_seconds('CAST(floor(lap) AS BIGINT)')} AS lap_text,
  CAST(floor(lap * CAST(n - idx AS DOUBLE)) AS BIGINT) AS eta_seconds,
  {_fmt_seconds('CAST(floor(lap * CAST(n - idx AS DOUBLE)) AS BIGINT)')} AS eta_text
FROM p, n"""

# --- scalar functions ------------------------------------------------------------------------


def _suffix_replace(path: str, new: str) -> str:
    suf = f"regexp_extract({path}, '[^/.](\\.[^./]+)$', 1)"
    pos = f"instr({path}, {suf})"
    return (f"CASE WHEN {pos} = 0 THEN {path} ELSE substr({path}, 1, {pos} - 1) || '{new}' || "
            f"substr({path}, {pos} + length({suf})) END")


def _replace_first(text: str, old: str, new: str) -> str:
    pos = f"instr({text}, '{old}')"
    return (f"CASE WHEN {pos} = 0 THEN {text} ELSE substr({text}, 1, {pos} - 1) || '{new}' || "
            f"substr({text}, {pos} + {len(old)}) END")


_DATAFILE = "('cfg/' || codec || '.json/data' || substr(id, 1, 12) || '.json')"
PATH_REWRITE = f"""WITH {TRIALS}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {_suffix_replace('infile_filename', '_ffprobe.json')} AS probe_path,
  {_replace_first(_DATAFILE, '.json', '_all.csv')} AS report_first,
  replace({_DATAFILE}, '.json', '_gby_type.csv') AS report_all
FROM trials"""

_OPT = ("(' ' || l_returnflag || '  -q ' || CAST(l_linenumber AS VARCHAR) || chr(9) || '-b  ' || l_linestatus || ' ')")
_TOK = f"list_filter(string_split_regex({_OPT}, '\\s+'), lambda t: t <> '')"
OPTION_TOKENS = (f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string({_TOK}, '|') AS tokens, "
                 f"CAST(len({_TOK}) AS BIGINT) AS n_tokens FROM lineitem")

COMMAND_LINE = f"""WITH {TRIALS}
SELECT id, 'ffmpeg -y -threads ' || threads
  || CASE WHEN codec = 'PROMO' THEN ' -hwaccel qsv' ELSE '' END
  || CASE WHEN infile_option <> '' THEN ' ' || infile_option ELSE '' END
  || ' -i ' || infile_filename || ' ' || outfile_options || ' -c:v ' || codec
  || CASE WHEN type = 'N' THEN '' ELSE ' -preset:v ' || preset END
  || ' ' || outfile_filename || '.mkv' AS commandline
FROM trials"""

FORMAT_SECONDS = (f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS seconds, "
                  f"{_fmt_seconds('CAST(floor(l_extendedprice) AS BIGINT)')} AS text FROM lineitem")
HMS = (f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {R(f'l_extendedprice * {D(1.5)}', 'seconds')}, "
       f"{_hms(f'l_extendedprice * {D(1.5)}')} AS hms FROM lineitem")

# --- frames, probes, references --------------------------------------------------------------
FRAMES = """frames AS (SELECT 'u/' || CAST(user_id AS VARCHAR) AS file, ts, event_id,
  CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'P' WHEN 'view' THEN 'B' ELSE '?' END AS pict_type
  FROM events)"""
SEGS = """segs AS (SELECT file, seg, COUNT(*) AS length FROM (
  SELECT file, CAST(SUM(CASE WHEN pict_type = 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg FROM frames) GROUP BY file, seg)"""
COUNTS = """counts AS (SELECT file, CAST(count_if(pict_type = 'I') AS BIGINT) AS "I",
  CAST(count_if(pict_type = 'P') AS BIGINT) AS "P", CAST(count_if(pict_type = 'B') AS BIGINT) AS "B",
  COUNT(*) AS frames FROM frames GROUP BY file)"""
FRAME_COUNTS = f'WITH {FRAMES}, {COUNTS} SELECT file, "I", "P", "B", frames, "I" + "P" + "B" AS total FROM counts'
GOP_SEGMENTS = f"WITH {FRAMES}, {SEGS} SELECT file, seg, length FROM segs"
FIRST_GOP = f"WITH {FRAMES}, {SEGS} SELECT file, arg_min(length, seg) AS gop FROM segs GROUP BY file"
POOL_SCORES = f"""SELECT 'u/' || CAST(user_id AS VARCHAR) AS file, event_type AS metric,
  {R('MIN(value)', 'min')}, {R('MAX(value)', 'max')}, {R(AVGX('value'), 'mean')},
  {R(f'CASE WHEN MIN(value) > {D(0)} THEN COUNT(value) / {SUMX(f'{D(1)} / value')} END', 'harmonic_mean')},
  COUNT(value) AS n
FROM events GROUP BY 1, 2"""

_BASE_SIZE = f"CAST(round(o_totalprice * {D(1000)}) AS BIGINT)"
BASE_PROBE_JOIN = f"""WITH {TRIALS}
SELECT id, 'clips/o' || CAST(l_orderkey AS VARCHAR) || '_ffprobe.json' AS base_probe_path,
  {R(D(120), 'base_duration')}, {_BASE_SIZE} AS base_size
FROM trials JOIN orders ON l_orderkey = o_orderkey"""

_STEM = "'t/' || concat_ws('_', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_OUT_SIZE = f"CAST(round(op.p_price * {D(1024)}) AS BIGINT)"
_OUT_RATE = f"CAST(round(op.p_price * {D(8192)} / {D(120)}) AS BIGINT)"
ENRICH_TRIALS = f"""WITH {TRIALS}, {FRAMES}, {SEGS}, {COUNTS},
fi AS (SELECT c.file, g.gop, c."I", c."P", c."B", c."I" + c."P" + c."B" AS total
       FROM counts c JOIN (SELECT file, arg_min(length, seg) AS gop FROM segs GROUP BY file) g ON c.file = g.file),
op AS (SELECT {_STEM} AS stem, l_discount AS p_disc, l_extendedprice AS p_price, l_linenumber AS p_ln,
              l_suppkey AS p_sk FROM lineitem),
mt AS (SELECT {_STEM} AS stem, l_tax AS m_tax, l_quantity AS m_q, l_linenumber AS m_ln FROM lineitem)
SELECT id,
  {R(D(120), 'infile_duration')},
  {R(f'CAST({_BASE_SIZE} AS DOUBLE) / {D(1024)}', 'infile_size_kbyte')},
  {R(f'CAST({_OUT_RATE} AS DOUBLE) / {D(1024)}', 'outfile_bit_rate_kbs')},
  {R(f'{D(120)} - op.p_disc', 'outfile_duration')},
  {R(f'CAST({_OUT_SIZE} AS DOUBLE) / {D(1024)}', 'outfile_size_kbyte')},
  fi.gop AS gop, CAST(op.p_ln % 3 AS BIGINT) AS has_b_frames, CAST(1 + op.p_sk % 4 AS BIGINT) AS refs,
  fi."I" AS "fI", fi."P" AS "fP", fi."B" AS "fB", fi.total AS "fT",
  {R('enc_sec', 'enc_sec')}, enc_time,
  {R('CAST(fi.total AS DOUBLE) / enc_sec', 'fps')},
  {R(f'({D(120)} - op.p_disc) / enc_sec', 'speed')},
  {R(f'{D(1)} - CAST({_OUT_SIZE} AS DOUBLE) / CAST({_BASE_SIZE} AS DOUBLE)', 'compression_ratio_persent')},
  '2.3.1' AS metric_version,
  {R(f'{D(1)} - mt.m_tax', 'ssim_min')}, {R(f'{D(1)} - mt.m_tax / {D(5)}', 'ssim_mean')},
  {R(f'{D(60)} + mt.m_q / {D(2)}', 'vmaf_min')}, {R(f'{D(90)} + {D(1.5)} * CAST(mt.m_ln AS DOUBLE)', 'vmaf_mean')}
FROM trials JOIN orders ON l_orderkey = o_orderkey
  JOIN op ON op.stem = trials.outfile_filename
  JOIN mt ON mt.stem = trials.outfile_filename
  JOIN fi ON fi.file = 'u/' || CAST(l_suppkey AS VARCHAR)"""

_PER_STEM = ENRICH_TRIALS[:ENRICH_TRIALS.index("SELECT id,")].rstrip()
_RECORD = {
    "infile_duration": D(120), "infile_size_kbyte": f"CAST({_BASE_SIZE} AS DOUBLE) / {D(1024)}",
    "outfile_hash": "rn.hash", "outfile_bit_rate_kbs": f"CAST({_OUT_RATE} AS DOUBLE) / {D(1024)}",
    "outfile_duration": f"{D(120)} - op.p_disc", "outfile_size_kbyte": f"CAST({_OUT_SIZE} AS DOUBLE) / {D(1024)}",
    "gop": "fs.gop", "has_b_frames": "CAST(op.p_ln % 3 AS BIGINT)", "refs": "CAST(1 + op.p_sk % 4 AS BIGINT)",
    "fI": 'fs."I"', "fP": 'fs."P"', "fB": 'fs."B"', "fT": "fs.total", "commandline": "'enc ' || rn.stem",
    "enc_sec": "rn.enc_sec", "enc_time": "rn.enc_time", "enc_fps": "CAST(fs.total AS DOUBLE) / rn.enc_sec",
    "enc_speed": f"({D(120)} - op.p_disc) / rn.enc_sec",
    "comp_ratio_persent": f"{D(1)} - CAST({_OUT_SIZE} AS DOUBLE) / CAST({_BASE_SIZE} AS DOUBLE)",
    "probe_sec": "rn.probe_sec", "probe_time": "rn.probe_time", "vmaf_sec": "rn.vmaf_sec", "vmaf_time": "rn.vmaf_time",
    "vmaf_version": "'2.3.1'", "vmaf_commandline": "'vmaf ' || rn.stem",
    "ssim_min": f"{D(1)} - mt.m_tax", "ssim_max": D(1), "ssim_amean": f"{D(1)} - mt.m_tax / {D(10)}", "ssim_mean": f"{D(1)} - mt.m_tax / {D(5)}",
    "vmaf_min": f"{D(60)} + mt.m_q / {D(2)}", "vmaf_max": D(100), "vmaf_amean": f"{D(91)} + {D(1.5)} * CAST(mt.m_ln AS DOUBLE)",
    "vmaf_mean": f"{D(90)} + {D(1.5)} * CAST(mt.m_ln AS DOUBLE)",
}
ENRICHED_RECORDS = f"""{_PER_STEM},
rn AS (SELECT outfile_filename AS stem, outfile_hash AS hash, enc_sec, enc_time, probe_sec, probe_time, vmaf_sec, vmaf_time FROM trials),
fs AS (SELECT outfile_filename AS stem, fi.gop, fi."I", fi."P", fi."B", fi.total
       FROM trials JOIN fi ON fi.file = 'u/' || CAST(l_suppkey AS VARCHAR))
SELECT {", ".join(R(_RECORD.get(c, "trials." + c), c) if c in RECORD_DOUBLES else f'{_RECORD.get(c, "trials." + c)} AS "{c}"' for c in RECORD_COLS)}
FROM trials JOIN orders ON l_orderkey = o_orderkey
  JOIN op ON op.stem = trials.outfile_filename JOIN mt ON mt.stem = trials.outfile_filename
  JOIN rn ON rn.stem = trials.outfile_filename JOIN fs ON fs.stem = trials.outfile_filename"""

REFS = """refs AS (SELECT s_name AS name, 'T' || CAST(s_nationkey AS VARCHAR) AS type,
  'refs/' || s_name || '.m2ts' AS basefile, sha256(s_name) AS basehash, s_acctbal FROM supplier)"""
VERIFY_REFERENCES = f"""WITH {REFS}
SELECT name, type, basefile, basehash,
  CASE WHEN s_acctbal > {D(8000)} THEN 'skipped' WHEN NOT (s_acctbal > {D(0)}) THEN 'missing'
       WHEN s_acctbal < {D(2000)} THEN 'mismatch' ELSE 'ok' END AS status
FROM refs"""
MISSING_REFERENCES = f"""WITH {REFS}
SELECT name, type, basefile, basehash FROM refs
WHERE NOT (s_acctbal > {D(0)}) AND NOT (s_acctbal > {D(8000)}) AND s_acctbal < {D(5000)}"""

# --- selection --------------------------------------------------------------------------------
ELIG = f"vmaf_min >= {D(70)} AND vmaf_mean >= {D(93)}"
PICK = ("outfile_options, preset, threads, " + R("outfile_size_kbyte", "outfile_size_kbyte") + ", "
        + R("comp_ratio_persent", "comp_ratio_persent") + ", " + R("vmaf_min", "vmaf_min") + ", "
        + R("vmaf_mean", "vmaf_mean"))
THRESHOLD_CANDIDATES = f"""WITH {TRIALS}, {TR}
SELECT codec, type, ref_type, {PICK}, eligible FROM (
  SELECT *, row_number() OVER (PARTITION BY codec, type, ref_type ORDER BY outfile_size_kbyte, outfile_options,
           preset, threads, comp_ratio_persent, vmaf_min, vmaf_mean) AS rn,
         COUNT(*) OVER (PARTITION BY codec, type, ref_type) AS eligible
  FROM tr WHERE {ELIG}) WHERE rn = 1"""
BEST_CANDIDATE = f"""WITH {TRIALS}, {TR},
el AS (SELECT * FROM tr WHERE {ELIG}),
b AS (SELECT codec, type, ref_type, MAX(comp_ratio_persent) AS best_comp FROM el GROUP BY codec, type, ref_type),
near AS (SELECT el.*, b.best_comp FROM el JOIN b USING (codec, type, ref_type)
         WHERE el.comp_ratio_persent >= b.best_comp - {D(0.03)})
SELECT codec, type, ref_type, {PICK}, {R('best_comp', 'best_comp')}, in_band FROM (
  SELECT *, row_number() OVER (PARTITION BY codec, type, ref_type ORDER BY vmaf_mean DESC, outfile_size_kbyte,
           outfile_options, preset, threads, comp_ratio_persent, vmaf_min) AS rn,
         COUNT(*) OVER (PARTITION BY codec, type, ref_type) AS in_band FROM near) WHERE rn = 1"""
DMET = ["outfile_size_kbyte", "outfile_bit_rate_kbs", "comp_ratio_persent", "ssim_mean", "vmaf_min", "vmaf_mean"]
_BK = ["codec", "type", "preset", "threads", "ref_type"]
DELTAS = (f"d AS (SELECT {', '.join('r.' + k + ' AS ' + k for k in _BK)}, r.outfile_options, '-q 1' AS baseline_options, "
          + ", ".join(f"r.{m} - b.{m} AS d_{m}" for m in DMET)
          + f", {D(100)} * (r.outfile_size_kbyte / b.outfile_size_kbyte - {D(1)}) AS size_change_pct "
          f"FROM tr r JOIN (SELECT * FROM tr WHERE outfile_options = '-q 1') b USING ({', '.join(_BK)}) "
          f"WHERE r.outfile_options <> '-q 1')")
_DSEL = (", ".join(_BK) + ", outfile_options, baseline_options, "
         + ", ".join(R(f"d_{m}", f"d_{m}") for m in DMET) + ", " + R("size_change_pct", "size_change_pct"))
BASELINE_DELTA = f"WITH {TRIALS}, {TR}, {DELTAS} SELECT {_DSEL} FROM d"
NO_EFFECT = (f"WITH {TRIALS}, {TR}, {DELTAS} SELECT {_DSEL} FROM d WHERE abs(size_change_pct) <= {D(1.0)} "
             f"AND greatest(abs(d_vmaf_min), abs(d_vmaf_mean)) <= {D(2.0)} AND abs(d_ssim_mean) <= {D(0.01)} "
             f"AND abs(d_comp_ratio_persent) <= {D(0.05)}")

FLAT_REPORT = (f"WITH {TRIALS} SELECT row_number() OVER (ORDER BY id, enc_sec, outfile_size_kbyte) - 1 AS index, "
                    f"{_sel(FLAT_COLS)} FROM trials")
SAVED_TRIALS = (f"WITH {GRID_BASE}, {_grid('g', False)}, {_grid('old', True)} SELECT id, config, 'written unchanged' AS said FROM old "
                "UNION ALL SELECT id, config, 'written unchanged' FROM g WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = g.id)")

ORACLE: dict[str, str] = {
    "flat_report": FLAT_REPORT,
    "type_report": _report(TYPE_KEYS),
    "option_report": _report(OPTION_KEYS),
    "quality_gate": QUALITY_GATE,
    "summary_by_ref": SUMMARY_BY_REF,
    "summary_by_codec": SUMMARY_BY_CODEC,
    "avg_of_avg": AVG_OF_AVG,
    "score": SCORE,
    "chart_rows": (f"WITH {TRIALS}, {ROWS} SELECT row_number() OVER (ORDER BY id, enc_sec, outfile_size_kbyte * {D(1000)}) - 1 AS index, "
                   + _sel([n for n, _ in CHART_COLS]) + " FROM rows"),
    "codec_filter": (f"WITH {TRIALS}, {ROWS} SELECT " + _sel([n for n, _ in CHART_COLS])
                     + f" FROM rows WHERE codec IN {SEL_CODECS}"),
    "codec_domain": f"WITH {TRIALS} SELECT DISTINCT codec FROM trials WHERE codec IS NOT NULL",
    "chart_groups": CHART_GROUPS,
    "chart_feed": CHART_FEED,
    "chart_factors": f'WITH {TRIALS}, {ROWS}, {GROUPS} SELECT DISTINCT "group" FROM grp',
    "axis_max": (f"WITH {TRIALS}, {ROWS}, {GROUPS} SELECT "
                 f"{R(f'CASE WHEN MAX(outfile_bit_rate_kbs) IS NULL THEN {D(1.1)} ELSE MAX(outfile_bit_rate_kbs) * {D(1.1)} END', 'axis_max')}, "
                 f"GREATEST(CAST(10 AS BIGINT), COUNT(*) - 1) AS initial_window, COUNT(*) AS n_groups FROM grp"),
    "chart_stack": (f"WITH {TRIALS}, {ROWS}, {GROUPS} "
                    "SELECT \"group\", 0 AS layer, 'B-Frame' AS frame_type, stream_frames_b AS frames FROM grp UNION ALL "
                    "SELECT \"group\", 1, 'P-Frame', stream_frames_p FROM grp UNION ALL "
                    "SELECT \"group\", 2, 'I-Frame', stream_frames_i FROM grp"),
    "report_roundtrip": _report(TYPE_KEYS),
    "reports_written": (f"SELECT 'all' AS kind, * FROM ({FLAT_REPORT}) UNION ALL BY NAME SELECT 'type' AS kind, * FROM ({_report(TYPE_KEYS)}) "
                        f"UNION ALL BY NAME SELECT 'option' AS kind, * FROM ({_report(OPTION_KEYS)})"),
    "has_trials": ("SELECT 'some' AS name, EXISTS (SELECT 1 FROM lineitem JOIN part ON l_partkey = p_partkey) AS has_trials "
                   "UNION ALL VALUES ('empty', false), ('none', false)"),
    "saved_trials": SAVED_TRIALS,
    "probe_log_files": f"""SELECT s_suppkey, CAST(CAST(round(abs(s_acctbal) * {D(1024)}) AS BIGINT) AS VARCHAR) AS size,
        CAST(CAST(round(abs(s_acctbal)) AS BIGINT) AS VARCHAR) AS bit_rate, CAST(1 + s_suppkey % 4 AS BIGINT) AS refs,
        count(l_suppkey) AS n_frames, (count(l_suppkey) + 9) // 10 AS n_i_frames, false AS has_frames
      FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY ALL""",
    "metric_log_files": f"""SELECT {_STEM} || '_vmaf.json' AS stem, '2.3.1' AS version, {R(f'{D(1)} - l_tax', 'ssim_min')}, {R(D(1), 'ssim_max')},
        {R(f'{D(1)} - l_tax / {D(10)}', 'ssim_mean')}, {R(f'{D(1)} - l_tax / {D(5)}', 'ssim_harmonic_mean')},
        {R(f'{D(60)} + l_quantity / {D(2)}', 'vmaf_min')}, {R(D(100), 'vmaf_max')},
        {R(f'{D(91)} + {D(1.5)} * CAST(l_linenumber AS DOUBLE)', 'vmaf_mean')},
        {R(f'{D(90)} + {D(1.5)} * CAST(l_linenumber AS DOUBLE)', 'vmaf_harmonic_mean')} FROM lineitem""",
    "enriched_records": ENRICHED_RECORDS,
    "trial_records": f"WITH {TRIALS} SELECT {_sel(RECORD_COLS, RECORD_DOUBLES)} FROM trials",
    "file_hashes": ("SELECT s_nationkey, sha256(string_agg(s_name || chr(10), '' ORDER BY s_suppkey)) AS sha256 "
                    "FROM supplier GROUP BY s_nationkey"),
    "probe_logs": (f"SELECT {_STEM} || '_ffprobe.json' AS path, "
                   f"CAST({D(120)} - l_discount AS VARCHAR) AS duration, "
                   f"CAST(CAST(round(l_extendedprice * {D(1024)}) AS BIGINT) AS VARCHAR) AS size, "
                   f"CAST(CAST(round(l_extendedprice * {D(8192)} / {D(120)}) AS BIGINT) AS VARCHAR) AS bit_rate, "
                   f"CAST(l_linenumber % 3 AS BIGINT) AS has_b_frames, CAST(1 + l_suppkey % 4 AS BIGINT) AS refs, "
                   f"CAST(1 AS BIGINT) AS n_streams FROM lineitem"),
    "grid_size": f"WITH {GRID_BASE}, {_grid('g', False)} SELECT config, COUNT(*) AS cells FROM g GROUP BY config",
    "param_grid": PARAM_GRID,
    "new_trials": NEW_TRIALS,
    "append_trials": APPEND_TRIALS,
    "pattern_filter": PATTERN_FILTER,
    "sequence_grid": SEQUENCE_GRID,
    "latest_by_id": LATEST_BY_ID,
    "trial_ids": TRIAL_IDS,
    "pending_trials": (f"WITH {TRIALS} SELECT id, codec, type, outfile_options, ref_name FROM trials "
                       f"WHERE outfile_hash = ''"),
    "completeness": (f"WITH {TRIALS} SELECT CAST(count_if(outfile_hash <> '') AS BIGINT) AS completed, COUNT(*) AS total, "
                     f"count_if(outfile_hash <> '') = COUNT(*) AS archive_ok FROM trials"),
    "progress_eta": PROGRESS_ETA,
    "format_seconds": FORMAT_SECONDS,
    "hms": HMS,
    "path_rewrite": PATH_REWRITE,
    "option_tokens": OPTION_TOKENS,
    "command_line": COMMAND_LINE,
    "frame_counts": FRAME_COUNTS,
    "gop_segments": GOP_SEGMENTS,
    "first_gop": FIRST_GOP,
    "pool_scores": POOL_SCORES,
    "base_probe_join": BASE_PROBE_JOIN,
    "enrich_trials": ENRICH_TRIALS,
    "verify_references": VERIFY_REFERENCES,
    "missing_references": MISSING_REFERENCES,
    "threshold_candidates": THRESHOLD_CANDIDATES,
    "best_candidate": BEST_CANDIDATE,
    "baseline_delta": BASELINE_DELTA,
    "no_effect": NO_EFFECT,
    "stream_chart_groups": CHART_GROUPS.replace(
        ROWS, "latest AS (SELECT * FROM trials QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_shipdate DESC, "
              "enc_sec DESC, outfile_size_kbyte DESC) = 1), " + ROWS.replace("FROM trials", "FROM latest")),
    "current_trials": f"""WITH {TRIALS}, deliveries AS (
        SELECT *, 0 AS no FROM trials UNION ALL SELECT *, 1 FROM trials WHERE ref_type = 'O'
        UNION ALL SELECT *, 2 FROM trials WHERE type = 'R')
      SELECT id, codec, type, ref_type, outfile_options, outfile_hash, CAST(no AS BIGINT) AS commit_no,
             {R('enc_sec + no', 'enc_sec')}, {R('outfile_size_kbyte', 'outfile_size_kbyte')}
      FROM deliveries QUALIFY row_number() OVER (PARTITION BY id ORDER BY no DESC, enc_sec DESC, outfile_size_kbyte DESC) = 1""",
    "stream_dedupe": f"WITH {TRIALS} SELECT codec, COUNT(DISTINCT id) AS trials FROM trials GROUP BY codec",
}
