"""trialgrid: parameter-sweep (encoding trial) analytics as Spark jobs.

Typical use::

    from trialgrid import build_session, read_trials
    from trialgrid.operators import reports, summary, chart

    spark = build_session()                       # or the cluster's session
    trials = read_trials(spark, "results/")       # nested records -> flat trial table
    by_type = reports.report_by_type(trials)
    summary.summary_by_codec(by_type).show()      # gated two-level summary
    chart.chart_groups(chart.chart_rows(trials, index=False), ["codec", "ref_type"])

Modules: `operators` (reports, summary, chart, grid, frames, probe, progress,
select, index), `functions` (ids, paths, command, timefmt, metrics),
`sources` (files, trials, tables), `streaming` (live), `plans` (registered
queries and their SQL oracles).
"""

from trialgrid.session import build_session, ensure_checkpoint_dir
from trialgrid.sources.files import read_report, read_trial_records, read_trials, write_reports
from trialgrid.sources.trials import flatten_trials, nest_trials

__all__ = ["build_session", "ensure_checkpoint_dir", "read_trials", "read_trial_records", "read_report",
           "write_reports", "flatten_trials", "nest_trials"]
