"""Levels of a grid whose cells hold more than four times the threshold."""

import numpy as np
import pytest

from geoloom.operators import histogram


@pytest.mark.parametrize("most", [41, 200, 10_000])
def test_deepest_level_within_the_grid(most):
    grid = np.zeros((8, 8))
    grid[2, 3] = most
    assert histogram.deepest_level(histogram.prefix_sum(grid), 40, beyond=False) == 3
    assert histogram.deepest_level(histogram.prefix_sum(grid), 40) == 3 + (most > 160) + sum(most / 4**k > 40 for k in range(2, 9))
