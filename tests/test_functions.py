import io
import math
import wave

import numpy as np
import pytest

from quarry.functions.porter import stem
from quarry.functions.wkt import bounds, distance
from quarry.operators.media import gradient_patches, mfcc, spectral


@pytest.mark.parametrize(
    "word, out",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"),
     ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("rate", "rate"), ("controll", "control")],
)
def test_stem(word, out):
    assert stem(word) == out


def test_geometry():
    square = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
    assert bounds(square) == (0, 0, 4, 4)
    assert distance(square, 0.5, 0.5) == 0
    assert distance(square, 2, 2) == 1  # in the hole
    assert distance("LINESTRING(0 0, 10 0)", 5, 3) == 3
    assert math.isclose(distance("POINT(1 1)", 4, 5), 5)
    with pytest.raises(ValueError):
        bounds("CIRCLE(0 0)")


def test_extractors():
    image = b"P5\n# c\n20 17\n255\n" + bytes(range(256)) + bytes(20 * 17 - 256)
    assert gradient_patches(image).shape == (4, 128)
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(22050)
        f.writeframes((np.sin(np.arange(22050) / 10) * 20000).astype("<i2").tobytes())
    assert mfcc(out.getvalue()).shape == (100, 20)
    assert spectral(out.getvalue()).shape == (100, 20)
    with pytest.raises(ValueError):
        gradient_patches(b"nonsense")
