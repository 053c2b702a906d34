"""RL samples: export, sequences, truncation, status, batches."""

from pyspark.sql import functions as F

from runlens.operators import rl as RL


def test_trajectory_export_golden(spark):
    steps = spark.createDataFrame([(1, 0, [1, 2, 3], [-0.1, -0.2, -0.3]), (2, 0, None, None)],
                                  "run_id long, step int, token_ids array<int>, logprobs array<double>")
    rewards = spark.createDataFrame([(1, 1.0), (2, 0.0)], "run_id long, reward double")
    got = {r.run_id: r for r in RL.trajectory_export(steps, rewards).collect()}
    assert got[1].response_token_ids == [1, 2, 3] and got[1].logprobs == [-0.1, -0.2, -0.3]
    assert got[1].reward == 1.0 and got[1].num_steps == 1
    assert got[2].response_token_ids == [] and got[2].logprobs == []


def test_sequence_masks(spark):
    steps = spark.createDataFrame([(1, 1, "observation", [7, 8], None, ""), (1, 0, "model", [1, 2], [-1.0, -2.0], "w1"),
                                   (1, 2, "model", [3], [-3.0], "")],
                                  "sample_id long, step int, kind string, token_ids array<int>, "
                                  "logprobs array<double>, weight_version string")
    r = RL.rl_sequence(steps).collect()[0]
    assert r.response_token_ids == [1, 2, 7, 8, 3] and r.loss_mask == [1, 1, 0, 0, 1]
    assert r.rollout_log_probs == [-1.0, -2.0, 0.0, 0.0, -3.0] and r.weight_versions == ["w1"]


def test_truncate_cases(spark):
    df = spark.createDataFrame([
        (1, [1] * 10, [2] * 100, [1] * 100, [0.0] * 100, 1.0, "stop", 100),
        (2, [1] * 90, [2] * 20, [1] * 20, [0.0] * 20, 1.0, "stop", 100),
        (3, [1] * 5, [2] * 5, [1] * 5, [0.0] * 5, -1.0, "weird", 100),
        (4, [1] * 5, [2] * 5, [1] * 5, [0.0] * 5, 1.0, "length", 100),
    ], "sample_id long, prompt_token_ids array<int>, response_token_ids array<int>, loss_mask array<int>, "
       "rollout_log_probs array<double>, reward double, finish_status string, budget int")
    got = {r.sample_id: (r.status, r.reward, r.response_length, len(r.loss_mask)) for r in RL.rl_truncate(df).collect()}
    assert got[1] == ("truncated", -1.0, 26, 26)   # room = 100 - 10 - 64
    assert got[2] == ("aborted", -1.0, 20, 20)     # negative room: arrays untouched, demoted
    assert got[3] == ("completed", -1.0, 5, 5)
    assert got[4] == ("truncated", 1.0, 5, 5)


def test_batch_skips_aborted_groups_and_orders_by_index(spark):
    s = spark.createDataFrame([(1, 5, "completed", 3), (1, 6, "completed", 4), (2, 1, "aborted", 1), (2, 2, "completed", 1),
                               (3, 0, "completed", 9), (4, 3, "completed", 2)],
                              "group_id long, sample_index long, status string, done_at long")
    got = [(r.group_id, r.batch_pos) for r in RL.collect_batch(s, 2).orderBy("batch_pos").collect()]
    assert got == [(4, 1), (1, 2)]
    flags = {r.group_id: r.retry for r in RL.group_abort_flag(s).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False}


def test_reward_and_status(spark):
    df = spark.createDataFrame([(True, "stop"), (False, "length"), (None, "abort"), (True, "x")],
                               "accepted boolean, fs string")
    got = df.select(RL.rl_reward(F.col("accepted")), RL.rl_reward(F.col("accepted"), evaluation=True),
                    RL.rl_status(F.col("fs"))).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, "completed"), (-1.0, 0.0, "truncated"), (-1.0, 0.0, "aborted"),
                                       (1.0, 1.0, "completed")]
