import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pageframe.operators import pixels, pixels_numpy as fast

RNG = np.random.default_rng(5)
IMAGES = [RNG.integers(0, 256, (8, 8)).astype(np.uint8) for _ in range(3)]


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame([(k, y, x, int(g[y, x])) for k, g in enumerate(IMAGES) for y in range(8) for x in range(8)], "img int, y int, x int, g int").cache()


def images(df):
    out = [np.zeros((8, 8), np.int64) for _ in IMAGES]
    for r in df.collect():
        out[r["img"]][r["y"], r["x"]] = r["g"]
    return out


@pytest.mark.parametrize(
    ("slow", "quick"),
    [
        (lambda p: pixels.median3(p, 8, 8), fast.median3), (lambda p: pixels.erode(p, 8, 8), fast.erode), (lambda p: pixels.dilate(p, 8, 8), fast.dilate), (lambda p: pixels.opened(p, 8, 8), lambda g: fast.dilate(fast.erode(g))),
        (lambda p: pixels.adaptive_threshold(p, 5, 5.0, 8, 8), lambda g: fast.adaptive(g, 5, 5.0)), (lambda p: pixels.sauvola(p, 5, 0.2, 8, 8), lambda g: fast.sauvola(g, 5, 0.2)), (lambda p: pixels.unsharp(p, 2, 0.5, 8, 8), lambda g: fast.sharpen(g, 2, 0.5)),
    ],
)
def test_relational_equals_numpy(px, slow, quick):
    for a, g in zip(images(slow(px)), IMAGES):
        assert (a == quick(g)).all()


def test_otsu(px):
    for r in pixels.otsu_threshold(px).collect():
        g = IMAGES[r["img"]]
        assert (fast.otsu(g) == np.where(g > r["threshold"], 255, 0)).all()


def test_examples():
    assert [int(fast.to_gray(np.array([[c]], np.uint8))[0, 0]) for c in ([255, 0, 0], [0, 255, 0], [0, 0, 255])] == [76, 150, 29]
    lone = np.full((3, 3), 50, np.uint8)
    lone[1, 1] = 255
    assert fast.median3(lone)[1, 1] == 50
    assert (fast.adaptive(np.full((5, 5), 128, np.uint8), 3, 5) == 255).all()
    assert fast.contrast(np.arange(100, 164, dtype=np.uint8).reshape(8, 8)).max() >= 63
    lines = np.full((200, 200), 255, np.uint8)
    lines[20:180:20] = 0
    assert abs(fast.skew(lines)) <= 1
    y, x = np.mgrid[0:200, 0:200]
    tilted = np.where(rounded_rows(y, x) % 20 < 2, 0, 255).astype(np.uint8)
    assert abs(fast.skew(fast.rotate(tilted, fast.skew(tilted)))) <= abs(fast.skew(tilted))


def rounded_rows(y, x):
    return np.floor(y - np.tan(np.radians(2)) * (x - 100) + 0.5).astype(int)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 3))
def test_box_mean_is_the_clipped_mean(h, w, half):
    g = np.arange(h * w, dtype=np.uint8).reshape(h, w)
    naive = [[g[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1].mean() for x in range(w)] for y in range(h)]
    assert np.allclose(fast.box_mean(g, half), naive)


def test_prepare_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(fast.png(np.tile(np.arange(64, dtype=np.uint8) * 4, (32, 1))))
    (tmp_path / "b.png").write_bytes(b"no image")
    rows = fast.prepare_images(spark.read.format("image").option("dropInvalid", False).load(str(tmp_path)), fast.Preparation(otsu=True, closed=True)).collect()
    good = next(r for r in rows if r["origin"].endswith("a.png"))
    assert (good["width"], good["height"], good["error"]) == (64, 32, None) and good["png"][:4] == b"\x89PNG"
    assert all(r["png"] is None and r["error"] for r in rows if r["origin"].endswith("b.png"))
