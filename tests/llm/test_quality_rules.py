import numpy as np

from paperlake.llm import quality


def test_all_distinct_rules_reach_the_lasso():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 20))
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(size=1500) > 0).astype(int)
    rules = quality.train(x, y, [str(i) for i in range(20)], penalty=0.0, steps=20)
    assert len(rules.rules) > 400
    assert {len(r) for r, _ in rules.rules} == {1, 2, 3} and max(r[0][0] for r, _ in rules.rules if len(r) == 3) > 15
