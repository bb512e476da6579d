"""Radii below two."""

import random

import numpy as np
import pytest

from lakemill.llm import simhash as S
from tests.llm.test_simhash import classes


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_radius(radius):
    rnd = random.Random(radius)
    fps = sorted({rnd.getrandbits(10) << 20 for _ in range(60)})
    root = S.unit_links(np.array(fps, dtype=np.uint64), np.zeros(len(fps), dtype=int), list(range(64)), radius=radius)
    while not (root[root] == root).all():
        root = root[root]
    want = classes(list(range(len(fps))), fps, radius)
    assert root.tolist() == [want[k] for k in range(len(fps))]
