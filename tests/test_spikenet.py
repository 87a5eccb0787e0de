"""Training by many workers: the weights of one, and a network that finds planted spikes."""

import numpy as np

from voxelane.operators import spikenet
from voxelane.operators.traces import sliding_windows


def windows_of(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for pix in range(4):
        spikes = set(rng.choice(200, 14, replace=False).tolist())
        rows += [(pix, t, float(rng.normal(0, 0.15) + (t in spikes)), t in spikes) for t in range(200)]
    return sliding_windows(spark.createDataFrame(rows, "pix long, t long, prob double, truth boolean"), 9, 3)


def test_workers_agree_and_learn(spark):
    data = windows_of(spark).cache()
    one = spikenet.train(data, 1, 6, 2, 400)
    three = spikenet.train(data, 3, 6, 2, 400)
    assert one.keys() == three.keys() and all(np.allclose(one[k], three[k], atol=1e-7) for k in one)
    net = spikenet.train(data, 2, 6, 24, 1000, 0.06, 0.0)
    both = spikenet.score(data, net).join(data, ["pix", "t"]).toPandas()
    assert len(both) == data.count()
    spike, rest = both[both["y"] > 0]["p"].to_numpy(), both[both["y"] == 0]["p"].to_numpy()
    assert (spike[:, None] > rest[None]).mean() > 0.9
    data.unpersist()


def test_units_are_left_out_at_the_rate_asked():
    keep = spikenet.kept_units(np.arange(2000, dtype=np.uint64), 3, 8, 0.2)
    assert keep.shape == (2000, 1, 8) and abs((keep == 0).mean() - 0.2) < 0.02 and np.allclose(keep[keep > 0], 1.25)


def test_steps_do_not_wait_for_a_barrier(spark):
    import time

    data = windows_of(spark).cache()
    spikenet.train(data, 2, 4, 1, 400)  # starts the workers
    began = time.time()
    spikenet.train(data, 2, 4, 2, 26)  # some 60 steps; behind a barrier each took a second at least
    assert time.time() - began < 45
