"""Image kernels, the preprocessing of pages, and text from pages."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import images, png
from quillspark.operators import preprocessing as P
from quillspark.sources import sinks


def test_png():
    rng = np.random.default_rng(3)
    for shape in ((5, 7), (4, 3, 3), (6, 2, 4)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (png.decode(png.encode(image)) == image).all()
    # every row filter: 0 none, 1 left, 2 up, 3 mean, 4 Paeth
    image = rng.integers(0, 256, (10, 12), dtype=np.uint8).astype(int)
    rows = []
    for i, line in enumerate(image):
        left, up = np.concatenate(([0] * 3, line[:-3])), image[i - 1] if i else line * 0
        corner = np.concatenate(([0] * 3, up[:-3]))
        guess = left + up - corner
        off = np.stack([abs(guess - left), abs(guess - up), abs(guess - corner)]).argmin(axis=0)
        near = [line * 0, left, up, (left + up) // 2, np.choose(off, [left, up, corner])][i % 5]
        rows.append([i % 5, *((line - near) % 256)])
    assert (png.unfiltered(np.array(rows, np.uint8), 3) == image).all()
    with pytest.raises(ValueError):
        png.decode(b"JFIF")


def test_alpha():
    rgba = np.zeros((6, 8, 4), np.uint8)
    rgba[1:5, 2:7] = (10, 20, 30, 255)
    rgba[2, 3] = (100, 100, 100, 202)
    out = images.composite(rgba)
    assert out.shape == (4, 5, 3) and tuple(out[0, 0]) == (10, 20, 30) and out[1, 1, 0] == int(100 * 202 / 255 + 255 * (1 - 202 / 255))
    faint = np.full((4, 4, 4), 100, np.uint8)
    assert images.composite(faint).shape == (4, 4, 3) and images.composite(rgba, False).shape == (6, 8, 3)


def text_page(height=120, width=160):
    page = np.full((height, width, 3), 240, np.uint8)
    for y in range(20, height - 20, 16):
        page[y : y + 5, 20 : width - 20] = 20
    return page


def test_deskew_turns_back():
    page = text_page()
    turned = images.rotated(page, -6)
    assert images.skew(images.grey(page)) == 0 and images.skew(images.grey(turned)) == pytest.approx(6, abs=1)
    back = images.deskewed(turned)
    assert abs(images.skew(images.grey(back))) <= 1 and back.shape == page.shape
    assert (images.rotated(page, 0) == page).all()


def test_sizes():
    page = text_page()
    assert images.upscaled(page, 0) is page and images.upscaled(page, 100) is page and images.upscaled(page, 240).shape == (240, 320, 3)
    assert abs(images.resized(np.full((9, 9), 77, np.uint8), 20, 5).astype(int) - 77).max() == 0


def test_light_and_colour():
    rng = np.random.default_rng(1)
    some = rng.integers(0, 256, (40, 40, 3), dtype=np.uint8)
    assert np.abs(images.from_lab(images.lab(some)).astype(int) - some).max() <= 1
    flat = np.full((64, 64), 100, np.uint8)
    assert images.equalised(flat).std() == 0
    slope = np.tile(np.linspace(90, 120, 64).astype(np.uint8), (64, 1))
    assert np.ptp(images.equalised(slope, 4.0).astype(int)) > np.ptp(slope.astype(int))
    page = text_page()
    page[:, 80:] = (page[:, 80:] * 0.6).astype(np.uint8)
    even = images.grey(images.lit_evenly(page)).astype(int)
    assert abs(even[5, 40] - even[5, 120]) < abs(int(page[5, 40, 0]) - int(page[5, 120, 0]))
    assert tuple(images.hsv(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [10, 10, 10]]], np.uint8))[0, :, 0]) == (0, 60, 120, 0)


def test_grid_goes_and_ink_stays():
    page = np.full((100, 100, 3), 250, np.uint8)
    page[::20] = page[:, ::20] = (120, 170, 220)
    page[45:52, 30:34] = 10
    clean = images.without_grid(page)
    assert np.abs(clean[20, 50].astype(int) - 250).max() <= 2 and (clean[48, 31] == 10).all()
    found = images.ink(clean)
    assert found[48, 31] == 255 and found[10, 10] == 0 and images.ink(np.full((9, 9, 3), 200, np.uint8)).max() == 0
    assert images.opened(np.array([[1, 1, 1, 0, 1]], bool), 1, 3).tolist() == [[True, True, True, False, False]]
    mask = np.zeros((5, 5), np.uint8)
    mask[2, 2] = 255
    assert images.thinned_or_thickened(mask, images.DEFAULTS | {"morph_op": "dilate", "morph_ksize": 3}).sum() == 9 * 255
    assert images.thinned_or_thickened(mask) is mask


def test_pipeline(spark, tmp_path):
    page = text_page()
    out = images.preprocessed(page)
    assert out.shape == (140, 180, 3) and set(np.unique(out)) <= {0, 255} and out[0, 0, 0] == 255
    rows = [("a.png", png.encode(page)), ("b.png", b"broken"), ("c.png", png.encode(page[..., 0])), ("d.png", None)]
    pages = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in P.preprocessed(pages, same_geometry=True, compare=True).collect()}
    assert [got[k].status for k in ("a.png", "b.png", "c.png", "d.png")] == ["ok", "error", "ok", "error"]
    same = png.decode(bytes(got["a.png"].content))
    assert same.shape == page.shape and same[22, 80, 0] == 0 and same[5, 5, 0] == 255
    assert png.decode(bytes(got["a.png"].comparison)).shape == (120, 320, 3)
    made = P.preprocessed(pages, same_geometry=True, compare=True)
    assert sinks.page_images(made, str(tmp_path)) == 4 and sorted(os.listdir(tmp_path)) == ["a.png", "c.png", "compare"]
    assert png.decode(open(f"{tmp_path}/compare/a_compare.png", "rb").read()).shape == (120, 320, 3)
    with pytest.raises(Exception, match="geometry changed"):
        P.preprocessed(pages.limit(1), {"border_px": 3}, same_geometry=True).collect()
    todo, skipped = P.unless_made(pages, pages.filter("path = 'a.png'").select("path"))
    assert todo.count() == 3 and [tuple(r) for r in skipped.collect()] == [("a.png", "skip")]
    assert P.unless_made(pages, pages, force=True)[0].count() == 4
    boxed = images.with_boxes(page, [(-5, 10, 30, 20)])
    assert tuple(boxed[10, 3]) == (255, 0, 0) and tuple(boxed[15, 10]) == (240, 240, 240)


def test_text_from_pages(spark):
    """Lines are found on the prepared page, cut from the page as it is, and read in order."""
    page = np.full((60, 80, 3), 200, np.uint8)
    page[10:20, 10:40], page[30:40, 10:60] = 50, 90
    pages = spark.createDataFrame([("f", 0, png.encode(page)), ("f", 1, png.encode(page[::-1]))], "path string, page int, content binary")

    def detector():
        def find(content):
            dark = (png.decode(content)[..., 0] < 100).any(axis=1)
            rows = np.flatnonzero(np.diff(np.concatenate(([0], dark.astype(int), [0]))))
            return [(10, a, 20, b - a, 0.5) for a, b in zip(rows[::2], rows[1::2], strict=True)][::-1]

        return find

    def reader():
        return lambda crops: [f" {png.decode(bytes(c)).min()}x{png.decode(bytes(c)).shape[0]}" for c in crops]

    darker = lambda df: df.withColumn("content", F.col("content"))
    lines = P.read_lines(pages, detector, reader, darker)
    assert [(r.page, r.line, r.y, r.text) for r in lines.orderBy("page", "line").collect()] == [(0, 1, 10.0, " 50x18"), (0, 2, 30.0, " 90x18"), (1, 1, 20.0, " 90x18"), (1, 2, 40.0, " 50x18")]
    assert [tuple(r) for r in P.page_texts(lines).collect()] == [("f", "50x18\n90x18\n\n90x18\n50x18")]
