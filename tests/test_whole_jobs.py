"""Queries that fit or resample do the whole job, inside a time limit."""

from __future__ import annotations

import time

import pytest

import workload.modelling as modelling
from cohortlens.operators import models
from workload import QUERIES
from workload.registry import Star

SF = "/root/testdata/sf0.01"
LIMIT = 400


@pytest.fixture
def clock():
    start = time.perf_counter()
    yield
    assert time.perf_counter() - start < LIMIT


def test_boosters_keep_their_rounds(spark, clock):
    star = Star(spark, SF)
    train, _ = modelling.split(star)
    ready = models.prepare_vectors(train, None, modelling.FEATURES, False, kinds=modelling.KINDS)
    for name, rounds in (("leaf_boost", 800), ("depth_boost", 800)):
        assert len(ready.fit(name).stages[-1].forest) == rounds
    stopped = ready.fit("hist_boost").stages[-1]
    assert 1 < len(stopped.forest) == stopped.curve.index(min(stopped.curve)) and len(stopped.curve) == len(stopped.forest) + 31


def test_all_candidates_are_trained_and_scored(spark, clock):
    assert {r["model"] for r in QUERIES["m5_train_and_score"](spark, SF).collect()} == set(models.CANDIDATES)


def test_search_runs_its_trials(spark, clock):
    got = QUERIES["m7_tune"](spark, SF).collect()
    assert sorted(r["trial"] for r in got) == list(range(1, 11)) and {r["folds_run"] for r in got} <= {1, 3} and got[0]["folds_run"] == 3


def test_every_block_is_left_out_once(spark, clock):
    got = {r["block"]: r["n_features"] for r in QUERIES["i4_block_ablation"](spark, SF).collect()}
    assert set(got) == {"(all features)", *(f"without {b}" for b in modelling.BLOCKS)} and sum(7 - n for n in got.values()) == 7
