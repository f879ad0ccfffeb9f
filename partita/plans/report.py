"""Text reports of what was measured; every table that they collect has a row per rank, bin, target or run."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: What a tenth of a list is shown as: nothing, some, at least its even share, at least twice that.
LEVELS = ((0.2, "#"), (0.1, "+"), (1e-12, "."), (-1.0, " "))


def profile(shares: list[float]) -> str:
    """One mark for each tenth of a list, by its share of the list's hits."""
    return "".join(next(mark for least, mark in LEVELS if s >= least) for s in shares)


def coverage_report(by_rank: DataFrame, histogram: DataFrame, overall: DataFrame) -> str:
    """Coverage by list rank with where in the lists the true rows stand; ranks after the last that finds anything are summed up."""
    tenths: dict[int, list[float]] = {}
    for r in histogram.orderBy("list_rank", "bin").collect():
        tenths.setdefault(r["list_rank"], []).append(r["share"])
    ranks = by_rank.orderBy("list_rank").collect()
    useful = [r for r in ranks if r["avg_found"] > 0]
    last = useful[-1]["list_rank"] if useful else 0
    lines = [f"overall recall {100 * overall.first()[0]:.1f} %", f"{'rank':>6}{'found':>9}{'recall':>9}{'place':>8}{'spread':>8}  front to back"]
    for r in ranks[:last]:
        lines.append(f"{r['list_rank']:>6}{r['avg_found']:>9.3f}{100 * r['cumul_recall']:>8.1f}%{r['mean_rel_pos']:>8.3f}{r['std_rel_pos']:>8.3f}  |{profile(tenths[r['list_rank']])}|")
    if last < len(ranks):
        lines.append(f"ranks {last + 1} to {len(ranks)} find nothing more")
    lines += ["", "share of a list's hits by tenths, in %"]
    lines += [f"{r['list_rank']:>6}" + "".join(f"{100 * s:>7.1f}" for s in tenths[r["list_rank"]]) for r in useful]
    return "\n".join(lines)


def runs_report(runs: DataFrame, best: DataFrame) -> str:
    """Every configuration's recall and cost, and the cheapest for each target."""
    lines = [f"{r['config']:<36} recall@{r['recall_at']:<4} {r['mean_recall']:.4f} (deviation {r['std_recall']:.4f}) at {r['cost']:.3f}" for r in runs.orderBy("seq", "recall_at").collect()]
    for r in best.orderBy("recall_at", "target").collect():
        lines.append(f"recall@{r['recall_at']} >= {r['target']:.2f}: " + (f"{r['config']} ({r['mean_recall']:.4f}, {r['cost']:.3f})" if r["config"] else "None"))
    return "\n".join(lines)
