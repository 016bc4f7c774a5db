"""The catalogue's restriction is on the lines themselves."""

import pytest

from affinis.plans.workspace import Workspace

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("noise", [False, True])
def test_lines_are_restricted_before_they_are_joined(spark, noise):
    w = Workspace(spark, DATA, catalog=True, noise=noise)
    few = w.vectors.where("item_id < 20")
    w.vectors = few
    plan = w.in_catalog._jdf.queryExecution().optimizedPlan().toString()
    lines = plan[plan.index("l_orderkey"):]
    semi, join = plan.index("LeftSemi"), plan.index("(l_orderkey")
    assert semi > join, lines  # below the join with orders
    whole = w.raw.where("item_id < 20")
    assert w.in_catalog.count() == whole.count() > 0 and w.in_catalog.exceptAll(whole.select(w.in_catalog.columns)).count() == 0


def test_plans_of_a_report_are_cut(spark):
    """What stages share, and each stage's row, are tables: the last plan has none of the steps before."""
    from affinis.plans import reports

    w = Workspace(spark, DATA, catalog=True, report=True)
    plan = reports.rating(w, ("global_mean", "mf", "bpr"))._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in plan and "Join" not in plan and len(plan.splitlines()) < 20
    assert w.release() is None and reports.rating(w, ("global_mean",)).count() == 1


def test_a_report_scores_factors_and_components_once(spark):
    """Stages of a report that are made of one another read the same tables: three held-out tables and four of candidates, whatever the stages."""
    from affinis.plans import reports

    class Counted(Workspace):
        calls: dict[str, int] = {}

    def counted(name):
        def run(self, *args):
            Counted.calls[name] = Counted.calls.get(name, 0) + 1
            return getattr(Workspace, name)(self, *args)

        return run

    for name in ("mf", "bpr", "near", "components"):
        setattr(Counted, name, counted(name))
    w = Counted(spark, DATA, catalog=True, report=True)
    stages = ("genome_content", "user_knn", "mf", "bpr", "hybrid", "mf_bpr")
    got = {r.stage: (r.rmse, r.ndcg) for r in reports.tradeoff(w, stages).collect()}
    assert Counted.calls == {"mf": 1, "near": 4, "components": 2}
    assert set(got) == set(stages)
