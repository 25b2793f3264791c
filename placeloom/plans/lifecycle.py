"""The plan's life as an event log: legal transitions folded in order, lists, constraint checks, the reaper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States from which each action leads on, and where to.
ACTIONS = {"propose": (("proposing", "proposed"), "proposed"), "approve": (("proposed",), "approved"), "claim": (("approved",), "compiling"), "finish": (("compiling",), "compiled"), "fail": (("compiling",), "failed"), "rearm": (("failed",), "approved"), "supersede": (("proposing", "proposed", "approved"), "superseded")}
STATES = ("proposing", "proposed", "approved", "compiling", "compiled", "failed", "superseded")
AFTER_APPROVAL = ("approved", "compiling", "compiled", "failed")


def next_state(state: Column, action: Column) -> Column:
    """The state after a legal action; an illegal one changes nothing."""
    out = state
    for name, (sources, to) in ACTIONS.items():
        out = F.when((action == name) & state.isin(*sources), F.lit(to)).otherwise(out)
    return out


def fold_states(log: DataFrame) -> DataFrame:
    """(plan_id, state, n_applied): the log (plan_id, seq, action) of each plan folded in order."""
    listed = log.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("log"))

    def step(a, e):
        new = next_state(a["state"], e["action"])
        return F.struct(new.alias("state"), (a["n"] + F.when(new != a["state"], 1).otherwise(0)).cast("long").alias("n"))

    folded = F.aggregate("log", F.struct(F.lit("proposing").alias("state"), F.lit(0).cast("long").alias("n")), step)
    return listed.select("plan_id", folded.alias("f")).select("plan_id", "f.state", F.col("f.n").alias("n_applied"))


def newest(plans: DataFrame, user: int | None = None, limit: int = 50) -> DataFrame:
    """Newest first, ties by the greater id; the limit held to 1..200; only the owner's."""
    own = plans if user is None else plans.where(F.col("user_id") == user)
    return own.orderBy(F.desc("created_at"), F.desc("plan_id")).limit(max(1, min(200, limit)))


def stale(plans: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """Claims that no one finished in time, strictly longer ago."""
    return plans.where((F.col("status") == "compiling") & (F.col("created_at") < now - F.expr(f"interval {minutes} minutes")))


def broken_rows(plans: DataFrame) -> DataFrame:
    """Rows that break a check: (plan_id, check_name)."""
    approved = F.col("status").isin(*AFTER_APPROVAL)
    checks = {
        "status": ~F.col("status").isin(*STATES),
        "approval": approved & (F.col("approved_at").isNull() | ~F.col("feasible")),
        "approver": F.col("approved_at").isNull() != F.col("approved_by").isNull(),
        "superseded": (F.col("status") == "superseded") != F.col("superseded_by").isNotNull(),
    }
    named = F.explode(F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in checks.items())), lambda c: c.isNotNull()))
    return plans.select("plan_id", named.alias("check_name"))


def refusal(plan: Column, hash_ok: Column, status: Column, feasible: Column) -> Column:
    """Why an approval did nothing, in the order the reasons are asked."""
    return (
        F.when(plan.isNull(), "not_found")
        .when(~hash_ok, "plan_stale")
        .when(status.isin(*AFTER_APPROVAL), "already_approved")
        .when(status == "superseded", "superseded")
        .when(~feasible, "infeasible")
        .when(status != "proposed", "not_approvable")
    )


def supersede(plans: DataFrame, asked: DataFrame) -> DataFrame:
    """Plans (plan_id, revision, status) after those asked for (plan_id, new_id) gave way: the old row points at its
    successor, a new one begins at the next revision.  A plan that may not be superseded stays as it is, and has none."""
    sources, to = ACTIONS["supersede"]
    met = plans.join(asked.select("plan_id", "new_id"), "plan_id", "left")
    goes = F.col("new_id").isNotNull() & F.col("status").isin(*sources)
    old = met.select("plan_id", "revision", F.when(goes, F.lit(to)).otherwise(F.col("status")).alias("status"), F.when(goes, F.col("new_id")).alias("superseded_by"))
    return old.unionByName(met.where(goes).select(F.col("new_id").alias("plan_id"), (F.col("revision") + 1).alias("revision"), F.lit("proposing").alias("status"), F.lit(None).cast("long").alias("superseded_by")))
