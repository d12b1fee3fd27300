"""Texts beyond what the index holds."""

import numpy as np
import pytest


def test_too_long_is_told():
    from reelgrid.llm import bwt

    n = bwt.MAX_TEXT + 1
    with pytest.raises(ValueError):
        bwt.repeated_windows(np.ones(n, np.uint8), 8, np.ones(n, np.int64))
