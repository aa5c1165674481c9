"""First steps of chains that candidates of a search share."""

import pytest
from pyspark.sql import functions as F

from sparktab.plans import chain, search
from sparktab.plans.chain import ChainConfig


@pytest.fixture(scope="module")
def rows(spark):
    x = F.when(F.col("id") % 11 != 0, (F.col("id") * 37 % 101).cast("double"))
    y = (F.col("id") * 53 % 97 + F.when(F.col("id") % 40 == 3, 900).otherwise(0)).cast("double")
    return spark.range(160).select("id", x.alias("x"), y.alias("y"), ((F.col("id") * 37 % 101 + F.col("id") * 7 % 40) > 70).cast("int").alias("label")).persist()


def test_candidates_share_first_steps_and_keep_their_results(rows, monkeypatch):
    make = lambda imputer, repair, limit, scaler: ChainConfig(imputer, scaler, "statistical", repair, 0.05, limit, "all", "identity", "lr", {"C": 0.5})
    configs = {"a": make("mean", "winsorize", 2.0, "zscore"), "b": make("mean", "none", 3.0, "robust"), "c": make("median", "mad_replace", 1.5, "zscore"),
               "bad": make("nonesuch", "none", 3.0, "zscore"), "bad2": make("nonesuch", "winsorize", 3.0, "zscore")}
    fitted, old = [], chain.fit_imputer
    monkeypatch.setattr(chain, "fit_imputer", lambda df, cols, label, row_id, option: fitted.append(option) or old(df, cols, label, row_id, option))
    starts = {}
    found = {(r["candidate"], r["fold"]): r.asDict() for r in search.search(rows, ["x", "y"], "label", "id", configs, 2, starts=starts).collect()}
    assert sorted(fitted) == ["mean"] * 2 + ["median"] * 2 + ["nonesuch"] * 2
    alone = {(r["candidate"], r["fold"]): r.asDict() for k, c in configs.items() for r in search.search(rows, ["x", "y"], "label", "id", {k: c}, 2).collect()}
    assert found == alone and all("nonesuch" in found[k, f]["fit_error"] for k in ("bad", "bad2") for f in (0, 1))
    fitted.clear()
    again = search.search(rows, ["x", "y"], "label", "id", {"a": configs["a"]}, 2, starts=starts).collect()
    assert not fitted and {(r["candidate"], r["fold"]): r.asDict() for r in again} == {k: v for k, v in alone.items() if k[0] == "a"}


def test_keys_tell_what_the_first_steps_learn():
    key = lambda **options: chain.start_key(ChainConfig("mean", "zscore", **options))
    assert key(detector="statistical", remediation="none", contamination=0.1) == key(detector="statistical", remediation="winsorize", mad_threshold=1.0)
    assert key(detector="iforest", contamination=0.1) != key(detector="iforest", contamination=0.2)
    assert key(detector="statistical", remediation="shrink") != key(detector="statistical", remediation="none")
    assert key(detector="statistical", remediation="cluster_local_median", contamination=0.1) != key(detector="statistical", remediation="cluster_local_median", contamination=0.2)
