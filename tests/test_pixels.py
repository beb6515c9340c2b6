"""Pixel operators on drawn frames against plain loops and known shifts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.constants import POSE_TEMPLATE
from motionloom.functions import images
from motionloom.operators import stabilize, templates


def frame_rows(spark, clips):
    """clip, frame, width, planes from {clip: [image or (image, ...)]}."""
    rows = []
    for clip, shots in clips.items():
        for k, shot in enumerate(shots):
            planes = shot if isinstance(shot, tuple) else (shot,)
            rows.append((clip, k, planes[0].shape[1], [p.ravel().tolist() for p in planes]))
    return spark.createDataFrame(rows, "clip string, frame int, width int, planes array<array<double>>").repartition(4)


def textured(seed, height, width):
    noise = np.random.default_rng(seed).uniform(0, 255, (height, width))
    return np.round((noise + np.roll(noise, 1, 0) + np.roll(noise, 1, 1)) / 3, 3)


def plain_cells(image):
    height, width = image.shape
    gy, gx = np.gradient(image)
    energy, out = gx**2 + gy**2, []
    w, h = max(24, int(width * 0.22)), max(24, int(height * 0.22))
    for corner, (x0, y0) in enumerate([(0, 0), (width - w, 0), (0, height - h), (width - w, height - h)]):
        peak = energy[y0 : y0 + h, x0 : x0 + w].max()
        if peak < 1e-6:
            continue
        for row in range(8):
            for col in range(8):
                cell = [(energy[y, x], -y, -x) for y in range(y0 + row * (h // 8), y0 + (row + 1) * (h // 8)) for x in range(x0 + col * (w // 8), x0 + (col + 1) * (w // 8))]
                score, y, x = max(cell)
                if score >= 0.2 * peak and 8 <= -x < width - 8 and 8 <= -y < height - 8:
                    out.append((corner, round(float(score), 6), float(-x), float(-y)))
    return sorted(out)


def test_corner_cells_equal_plain_loops(spark):
    shots = {"a": [textured(1, 130, 170)], "flat": [np.full((64, 64), 9.0)], "rgb": [(textured(2, 64, 90), textured(3, 64, 90), textured(4, 64, 90))]}
    got = templates.corner_grid(frame_rows(spark, shots), ["clip"]).collect()
    grays = {"a": shots["a"][0], "flat": shots["flat"][0], "rgb": sum(w * p for w, p in zip((0.299, 0.587, 0.114), shots["rgb"][0]))}
    for clip, gray in grays.items():
        assert sorted((r.corner, round(r.score, 6), r.x, r.y) for r in got if r.clip == clip) == plain_cells(gray)


def test_window_sums_by_transform_equal_direct_ones(monkeypatch):
    image, kernel = textured(5, 60, 80), textured(6, 9, 7)
    direct = images.window_sums(image, kernel)
    assert direct[3, 4] == pytest.approx((image[3:12, 4:11] * kernel).sum())
    monkeypatch.setattr(images, "DIRECT_PRODUCTS", 0)
    assert np.allclose(images.window_sums(image, kernel), direct, rtol=1e-9)
    template, mask = np.stack([kernel, kernel + 1]), images.ellipse_mask(7, 9)
    differences = images.ssd_map(np.stack([image, image]), template, mask)
    assert differences[10, 20] == pytest.approx(sum((mask * (image[10:19, 20:27] - t) ** 2).sum() for t in template))
    assert images.ssd_map(np.stack([image[:5], image[:5]]), template, mask).size == 0


@pytest.mark.parametrize(("dx", "dy"), [(12, -7), (40, 33), (-120, 85)])
def test_far_templates_are_found_coarse_to_fine(dx, dy):
    base = 100 + textured(7, 450, 700) / 40
    base[213:228, 343:358] = np.kron(textured(8, 5, 5), np.ones((3, 3)))
    image = np.roll(base, (dy, dx), axis=(0, 1))
    patch = images.patch_at(base, 350, 220)
    x, y, score = images.ncc_seek(image, patch, 350, 220)
    assert (x, y) == (350 + dx, 220 + dy) and score == pytest.approx(1.0)
    assert images.patch_at(base, 3, 200) is None and images.patch_at(np.zeros((40, 40)), 20, 20) is None


def test_a_shaken_clip_is_followed_from_pixels_to_shifts(spark):
    shifts = [(0, 0), (3, -2), (9, 4), (-14, 6), (0, 0), (21, -11)]
    base = textured(9, 160, 200)
    shots = [np.roll(base, (dy, dx), axis=(0, 1)) for dx, dy in shifts]
    clips = {"shaken": shots, "still": [base, base, base], "flat": [np.full((80, 80), 5.0)] * 2}
    frames = frame_rows(spark, clips)
    cells = templates.corner_grid(frames.filter("frame = 0"), ["clip"])
    anchors = stabilize.pick_anchors(cells, ["clip"])
    tracked = templates.track_anchors(frames, anchors, ["clip"])
    assert tracked.filter("clip = 'flat'").count() == 0
    got = {(r.clip, r.frame): (r.dx, r.dy) for r in stabilize.estimate_shake(tracked, ["clip"]).collect()}
    assert [got["shaken", k] for k in range(len(shifts))] == [(float(dx), float(dy)) for dx, dy in shifts]
    assert [got["still", k] for k in range(3)] == [(0.0, 0.0)] * 3


def test_frames_matched_one_by_one(spark):
    base = textured(11, 120, 120)
    rows = spark.createDataFrame([(k, k, 120, np.roll(base, (k, 2 * k), axis=(0, 1)).ravel().tolist(), base.ravel().tolist(), 60.0, 60.0) for k in range(4)], "clip int, frame int, width int, gray array<double>, source array<double>, x double, y double")
    got = sorted((r.frame, r.found_x, r.found_y, r.accepted) for r in templates.ncc_match(rows, ["clip"]).collect())
    assert got == [(k, 60.0 + 2 * k, 60.0 + k, True) for k in range(4)]
    assert templates.ncc_match(rows.withColumn("x", F.lit(2.0)), ["clip"]).count() == 0
    three = rows.withColumns({"planes": F.array("gray", "gray", "gray"), "source": F.array("source", "source", "source")})
    for r in templates.ssd_match(three, ["clip"], template=(31, 31)).collect():
        assert abs(r.found_x - 60 - 2 * r.frame) < 0.6 and abs(r.found_y - 60 - r.frame) < 0.6 and r.confidence > 0.9


def test_a_template_follows_its_target_until_it_is_gone(spark):
    ground = textured(13, 150, 260) / 8
    disc = (np.hypot(*np.mgrid[-20:21, -20:21]) <= 14) * textured(14, 41, 41)
    shots = []
    for k in range(24):
        shot = ground.copy()
        if k < 12:
            x, y = 40 + 9 * k, 60 + 2 * k
            shot[y - 20 : y + 21, x - 20 : x + 21] += disc
        shots.append((shot, shot, shot))
    frames = frame_rows(spark, {"a": shots, "b": [(ground,) * 3] * 3, "late": shots[:5]})
    prompts = spark.createDataFrame([("a", 0, "point", 9.0, 9.0, None, None), ("a", 1, "box", 60.0, 40.0, 20.0, 80.0), ("a", 2, "negative", 1.0, 1.0, None, None), ("b", 0, "point", 3.0, 3.0, None, None), ("late", 0, "point", 40.0, 60.0, None, None)], "clip string, ord int, kind string, x double, y double, x2 double, y2 double")
    seeds = templates.template_seeds(prompts, ["clip"])
    assert {tuple(r) for r in seeds.collect()} == {("a", 40.0, 60.0, 40, 40, True), ("b", 3.0, 3.0, 31, 31, False), ("late", 40.0, 60.0, 31, 31, False)}
    points = templates.autotrack(frames, seeds, ["clip"]).cache()
    got = {(r.clip, r.frame): r for r in points.collect()}
    assert not any(clip == "b" for clip, _ in got)
    for k in range(12):
        assert got["a", k].visible and abs(got["a", k].x - 40 - 9 * k) < 1.1 and abs(got["a", k].y - 60 - 2 * k) < 1.1
    assert not any(got["a", k].visible for k in range(12, 24)) and got["a", 23].lost_streak == 12
    assert {tuple(r) for r in templates.target_lost(points, ["clip"]).collect()} == {("a", True), ("late", False)}


def test_drawn_keypoints_are_assigned(spark):
    image = np.zeros((200, 120))
    for k, (_, dx, dy) in enumerate(POSE_TEMPLATE):
        if k not in (7, 16):
            image[20 + dy + k % 2, 60 + dx] = 200
    image[190, 10] = 255
    rows = frame_rows(spark, {"a": [image], "none": [np.zeros((50, 50))]})
    peaks = images.merge_peaks(images.bright_peaks(F.get("planes", F.lit(0)), F.col("width"), 160.0))
    given = rows.select("clip", peaks.alias("p")).select("clip", images.assign_keypoints(F.col("p"), POSE_TEMPLATE).alias("g")).collect()
    found = {r.clip: r.g for r in given}
    assert found["none"] is None
    assert [g.name for g in found["a"]] == [n for n, _, _ in POSE_TEMPLATE]
    for k, ((_, dx, dy), g) in enumerate(zip(POSE_TEMPLATE, found["a"], strict=True)):
        want = (60.0 + dx, 20.0 + dy) if k in (7, 16) else (60.0 + dx, 20.0 + dy + k % 2)
        assert (g.x, g.y, g.confidence) == (*want, 0.55 if k in (7, 16) else 0.95)


def test_board_corners_by_id_or_by_box(spark):
    rows = [("all", k, i, float(k * 3 % 7), float(k)) for k, i in enumerate([0, 1, 2, 3, 4, 5, 0])]
    rows += [("one lacks", k, i, float(k), float(-k)) for k, i in enumerate([0, 2, 3, 4])] + [("none", k, 40 + k, float(k), 2.0) for k in range(3)]
    points = spark.createDataFrame(rows, "board string, ord int, id int, x double, y double")
    got = {}
    for r in templates.plane_corners(points, ["board"], (4, 3)).orderBy("corner").collect():
        got.setdefault(r.board, []).append((r.x, r.y, r.by_id))
    at = {i: (x, y) for b, _, i, x, y in rows if b == "all"}
    assert got["all"] == [(*at[i], True) for i in (0, 2, 5, 3)]
    assert got["one lacks"] == [(0.0, 0.0, False), (3.0, 0.0, False), (3.0, -3.0, False), (0.0, -3.0, False)]
    assert got["none"] == [(0.0, 2.0, False), (2.0, 2.0, False), (2.0, 2.0, False), (0.0, 2.0, False)]
