"""Golden cases, properties and brute-force versions."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from acoustics_spark.functions import boxes, names, signal
from acoustics_spark.operators import intervals, matching, slices, splits, timeline, variants, windows
from acoustics_spark.schemas import DETECTIONS, require_columns, require_ratios

SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def detections(spark, spans, path="a"):
    rows = [(path, i, 0.0, 1.0, i, float(s), float(e), float(e - s), 1.0 + i, 2.0 + i, i / 10) for i, (s, e) in enumerate(spans)]
    return spark.createDataFrame(rows, DETECTIONS)


def slow_merge(spans, tol):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + tol:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@SLOW
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 6)), min_size=1, max_size=25), st.sampled_from([0, 0.5, 2]))
def test_merge_equals_a_plain_loop(spark, rows, tol):
    spans = [(s, s + n) for s, n in rows]
    got = intervals.merge_overlapping(detections(spark, spans), tol).orderBy("start_time").collect()
    want = slow_merge(spans, tol)
    assert [(r.start_time, r.end_time) for r in got] == want
    again = intervals.premerge(detections(spark, spans), 5.0, tol).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time) for r in again] == want


def test_touching_intervals_merge_and_backward_ones_go(spark):
    got = intervals.merge_overlapping(detections(spark, [(0, 1), (1, 2), (3, 4), (9, 8)])).orderBy("start_time").collect()
    assert [(r.start_time, r.end_time, r.low_freq, r.high_freq, r.detection_index) for r in got] == [(0, 2, 1, 3, 0), (3, 4, 3, 4, 2)]


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


@pytest.mark.parametrize(
    ("duration", "want"),
    [(2.9, []), (3.0, [0]), (5.0, [0, 1, 2]), (5.25, [0, 1, 2, 2.25]), (5.0000004, [0, 1, 2]), (36000.03, [*range(35998)]), (3.5, [0, 0.5])],
)
def test_window_grid(spark, duration, want):
    got = one(spark, w=boxes.window_starts(F.lit(duration), 3.0, 1.0)).w
    assert got == pytest.approx(want)


@SLOW
@given(st.floats(0, 200), st.floats(0.5, 5), st.floats(0.25, 4))
def test_windows_cover_the_recording(spark, duration, window, hop):
    got = one(spark, w=boxes.window_starts(F.lit(duration), window, hop)).w
    if duration + 1e-6 < window:
        assert got == []
    else:
        assert got[0] == 0 and duration - (got[-1] + window) <= max(1e-6, 1e-6 * duration) + 1e-9 and all(b - a <= hop + 1e-9 for a, b in zip(got, got[1:]))


@SLOW
@given(st.floats(0, 50), st.floats(0.01, 3), st.floats(0, 10000), st.floats(1, 2000), st.floats(-2, 2))
def test_box_round_trip(spark, left, length, bottom, height, shift):
    right, top = left + length, bottom + height
    a = [F.lit(float(x)) for x in (left, right)]
    start = boxes.window_start_for(*a, 3.0, F.lit(60.0), F.lit(shift))
    box = boxes.to_box(*a, F.lit(bottom), F.lit(top), start, 3.0, 12000.0)
    r = one(spark, s=start, p=boxes.box_to_physical(box, start, 3.0, 12000.0))
    assert r.s <= left + 1e-9 and right <= r.s + 3 + 1e-9 and 0 <= r.s <= 57
    assert (r.p.start_time, r.p.end_time, r.p.low_freq, r.p.high_freq) == pytest.approx((left, right, bottom, top), abs=1e-6)


def test_impossible_windows_are_null(spark):
    f = lambda a, b, d: one(spark, s=boxes.window_start_for(F.lit(a), F.lit(b), 3.0, F.lit(d), F.lit(0.0))).s
    assert f(1.0, 5.0, 60.0) is None and f(1.0, 2.0, 2.0) is None and f(0.0, 1.0, 60.0) == 0.0 and f(59.0, 60.0, 60.0) == 57.0


def test_shift_offsets_stay_in_bounds_and_alternate(spark):
    rows = [(i, 20.0, 20.0 + (i % 5) * 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, left double, right double").withColumn("audio_duration", F.lit(60.0))
    base = windows.base_windows(df, 3.0)
    got = variants.shift_plans(base, 3.0, 0.25, 0.5, 1.0, 4).collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    for own in by.values():
        (b,) = [r for r in own if r.kind == "base"]
        shifts = [r for r in own if r.kind != "base"]
        assert all(0.5 - 1e-6 <= abs(r.window_start - b.window_start) <= 1.0 + 1e-6 for r in shifts)
        assert all(r.window_start <= r.left + 1e-9 and r.right <= r.window_start + 3 + 1e-9 for r in shifts)
        assert all((r.kind == "shiftneg") == (r.window_start < b.window_start) for r in shifts)
    assert {len(o) for o in by.values()} == {5}
    assert len({r.window_start for r in got}) > 8


def test_variants_multiply_training_samples_only(spark):
    box = "array<struct<class_id:int,x_center:double,y_center:double,width:double,height:double>>"
    rows = [("train", "base", None, [(0, 0.2, 0.5, 0.1, 0.1)]), ("train", "shift", 1, [(0, 0.3, 0.5, 0.1, 0.1)]), ("val", "base", None, [(0, 0.2, 0.5, 0.1, 0.1)])]
    df = spark.createDataFrame(rows, f"split string, kind string, variant int, boxes {box}")
    got = variants.variants(df, drops=1, masks=2, flip=True).collect()
    assert len(got) == 5 + 5 + 1
    assert sorted(r.boxes[0].x_center for r in got if r.kind == "flip") == pytest.approx([0.7, 0.8])
    for r in variants.plan_strips(spark.range(50)).collect():
        up, level = r.rectangles
        assert (up.y, up.height, level.x, level.width) == (0, 1, 0, 1) and max(up.width, level.height) <= 0.1 and up.x + up.width <= 1 and level.y + level.height <= 1
    r = variants.plan_masks(spark.range(50), 3).collect()
    assert all(0.05 <= q.width <= 0.2 and 0 <= q.x and q.x + q.width <= 1 and q.y + q.height <= 1 for x in r for q in x.rectangles)


def test_splits_are_exact_disjoint_and_seeded(spark):
    df = spark.range(1003).withColumn("clash", F.lit(1))
    a = {r.id: r.split for r in splits.assign_splits(df, 0.7, 0.2, 0.1, 1).collect()}
    b = {r.id: r.split for r in splits.assign_splits(df, 0.7, 0.2, 0.1, 2).collect()}
    sizes = {s: list(a.values()).count(s) for s in ("train", "val", "test")}
    assert sizes == {"train": 702, "val": 201, "test": 100} and a != b and len(a) == 1003
    assert splits.assign_splits(df.limit(0), 0.7, 0.2, 0.1).count() == 0
    with pytest.raises(ValueError):
        require_ratios(0.7, 0.2, 0.2)
    with pytest.raises(ValueError):
        require_columns(df, ["id", "nope"])


def test_global_index_over_many_partitions(spark):
    df = spark.range(5000).withColumn("k", F.col("id") * 7919 % 5003).repartition(7)
    got = splits.global_index(df, "k").orderBy("k").collect()
    assert [r.global_index for r in got] == list(range(1, 5001))


def test_slice_length_of_no_annotations(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0)], "left double, right double")
    assert splits.duration_stats(df, 3.0).count() == 0
    assert splits.duration_stats(df.unionAll(spark.createDataFrame([(0.0, 8.5)], df.schema)), 3.0).first().slice_seconds == 8.0


def slow_map(a, segs, tol=1e-3):
    for pos, name, audio, s, e in segs:
        if audio and s - tol <= a[0] <= e + tol:
            return (name, "past_end" if a[1] > e + tol else "ok")
    return (None, "unmatched")


def test_annotations_map_to_the_earliest_segment(spark):
    rows = [("m", i, n) for i, n in enumerate(["a.wav", "b.WAV", "spacer.wav", "c.wav", "notes.txt"])]
    entries = spark.createDataFrame(rows, "metafile string, pos long, entry_name string")
    recs = spark.createDataFrame([("a.wav", 10.0), ("b.WAV", 5.0), ("c.wav", 300.0)], "entry_name string, duration double")
    segs = timeline.build_timeline(timeline.with_durations(entries, recs, default=2.5))
    listed = [(r.pos, r.entry_name, r.is_audio, r.start, r.end) for r in segs.orderBy("pos").collect()]
    assert [(x[3], x[4]) for x in listed] == [(0, 10), (10, 15), (15, 17.5), (17.5, 317.5), (317.5, 320)]
    anns = [(i, "m", left, left + n) for i, (left, n) in enumerate([(0.0, 1), (9.0, 1.0005), (10.0, 2), (10.0005, 1), (10.002, 1), (15.0005, 0.0001), (16.0, 1), (17.4995, 1), (200.0, 100), (310.0, 9), (400.0, 1), (-1.0, 3)])]
    df = spark.createDataFrame([(*a[:2], float(a[2]), float(a[3])) for a in anns], "id long, metafile string, left double, right double")
    got = {r.id: r for r in timeline.map_to_segments(df, segs).collect()}
    assert {i: (got[i].entry_name, got[i].status) for i in got} == {a[0]: slow_map(a[2:], listed) for a in anns}
    assert got[7].left_rel == 0 and got[6].reason == "starts in spacer.wav" and got[10].reason == "starts outside the timeline"
    good, bad = timeline.good_and_rejects(timeline.map_to_segments(df, segs))
    assert good.count() + bad.count() == len(anns)
    with pytest.raises(ValueError):
        timeline.good_and_rejects(timeline.map_to_segments(df, segs), strict=True)


def test_repeated_and_unnamed_rows_stay(spark):
    segs = timeline.build_timeline(timeline.with_durations(spark.createDataFrame([("m", 0, "a.wav")], "metafile string, pos long, entry_name string"), spark.createDataFrame([("a.wav", 10.0)], "entry_name string, duration double")))
    rows = spark.createDataFrame([(1, "m", 1.0, 2.0), (1, "m", 3.0, 4.0), (None, "m", 5.0, 6.0), (None, "m", 5.0, 6.0), (None, None, 5.0, 6.0), (2, "m", None, 1.0)], "id long, metafile string, left double, right double")
    assert sorted((str(r.id), str(r.left_rel), r.status) for r in timeline.map_to_segments(rows, segs).collect()) == [("1", "1.0", "ok"), ("1", "3.0", "ok"), ("2", "None", "unmatched"), ("None", "5.0", "ok"), ("None", "5.0", "ok"), ("None", "None", "unmatched")]
    sigs = spark.createDataFrame([("f", "m", "l", "bird", 0)], "folder string, meta string, log string, name string, seq long")
    rows = spark.createDataFrame([(1, "f", "m", "bird"), (1, "f", "m", "a bird"), (None, "f", "m", "bird"), (None, "f", "m", "bird"), (3, None, "m", "bird")], "id long, folder string, meta string, comment string")
    assert matching.match_names(rows, matching.build_token_table(sigs)).count() == 4


def test_names_equal_a_plain_search(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abc -_"), rng.integers(1, 9)))
    sigs = [("f", "m", "l", word(), i) for i in range(60)]
    rows = [(i, "f", "m", word() + word() + word()) for i in range(300)]
    table = matching.build_token_table(spark.createDataFrame(sigs, "folder string, meta string, log string, name string, seq long"))
    tokens = sorted(((-len(t.token), t.first.seq, t.first.k, t.token, t.names[0]) for t in table.collect()))
    want = {}
    for i, _, _, comment in rows:
        low = comment.lower().strip(" ")
        forms = [low, low.replace("-", "_"), low.replace("_", " "), low.replace(" ", "_")]
        hit = next((t[4] for t in tokens if any(t[3] in f for f in forms)), None)
        if low and hit is not None:
            want[i] = hit
    got = matching.match_names(spark.createDataFrame(rows, "id long, folder string, meta string, comment string"), table, gram=3)
    assert {r.id: r.annotation_name for r in got.collect()} == want and len(want) > 50


def test_spacer_durations(spark):
    rows = spark.createDataFrame([("m", 0, "Spacer.WAV"), ("m", 1, "spacer"), ("m", 2, "other_spacer.wav"), ("n", 0, "Spacer.WAV"), ("n", 1, "x_spacer.wav")], "metafile string, pos long, entry_name string")
    recs, over = spark.createDataFrame([("Spacer.WAV", 4.0), ("spacer", 9.0)], "entry_name string, duration double"), spark.createDataFrame([("m", 7.0)], "metafile string, spacer double")
    got = lambda **k: [r.duration for r in timeline.with_durations(rows, recs, over, 2.5, **k).orderBy("metafile", "pos").collect()]
    assert got() == [7, 7, 7, 2.5, 2.5] and got(spacer_recordings=True) == [4, 7, 7, 4, 2.5]


def test_tokens_and_names(spark):
    r = one(spark, t=names.match_tokens(F.lit(" Sig-Red_Bird ")), c=names.comment_forms(F.lit("A-b_c d")), o=names.metafile_candidates(F.lit("Site A metafile.txt"), F.lit("Dir")))
    assert r.t == ["sig-red_bird", "sig_red_bird", "sig red bird", "red_bird", "red bird"]
    assert r.c == ["a-b_c d", "a_b_c d", "a-b c d", "a-b_c_d"]
    assert r.o[0] == "site a metafile.txt" and {"site a", "site a metafile", "dir", "dir_metafile"} <= set(r.o)
    r = one(spark, a=names.sanitize(F.lit("é x/.")), b=names.sanitize(F.lit("//")), c=names.sanitize_audio(F.lit("é.1 ")), d=names.stem(F.lit("a\\b/c.d.wav")), e=names.parse_override(F.lit("Foo = 2.5")), f=names.parse_override(F.lit("Foo=-1")))
    assert (r.a, r.b, r.c, r.d, r.f) == ("é_x", "item", ".1", "c.d", None) and (r.e.name, r.e.seconds) == ("foo", 2.5)
    r = one(spark, a=names.top_level_folder(F.lit("/r/x/y.txt"), "/r"), b=names.top_level_folder(F.lit("/r/y.txt"), "/r/"), c=names.top_level_folder(F.lit("/q/z/y.txt"), "/r"), d=names.detection_name(F.lit("a b"), F.lit(3), F.lit(1.5), F.lit(2.25), F.lit(0.5)), e=F.element_at(names.slash_variants(F.lit("a/b")), 2))
    assert (r.a, r.b, r.c, r.d, r.e) == ("x", "y.txt", "z", "a_b_det0003_start0001.50s_end0002.25s_conf0.50", "a\\b")


def test_longest_token_names_a_comment(spark):
    sigs = spark.createDataFrame([("f", "m", "l", "sig_red bird", 0), ("f", "m", "l", "sig_bird", 1), ("f", "m", "", "sig_x", 2), ("g", "m", "l", "bird", 3)], "folder string, meta string, log string, name string, seq long")
    rows = spark.createDataFrame([(1, "f", "m", "a RED bird"), (2, "f", "m", "big_bird"), (3, "f", "m", "x"), (4, "g", "m", "red bird"), (5, "h", "m", "bird"), (6, "f", "m", None)], "id long, folder string, meta string, comment string")
    got = {r.id: r.annotation_name for r in matching.match_names(rows, matching.build_token_table(sigs)).collect()}
    assert got == {1: "sig_red bird", 2: "sig_bird", 4: "bird"}


def slow_features(x, rate):
    """Floor, peak and crossings of one slice, by a literal walk."""
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2
    freqs = np.fft.rfftfreq(len(x), 1 / rate)
    on = (freqs >= 4000) & (freqs <= 12000)
    freqs, power = freqs[on], power[on]
    floor = max(np.percentile(power, 10), 1e-12)
    soft = np.convolve(power, np.ones(min(5, len(power))) / min(5, len(power)), mode="same") if len(power) > 1 else power
    peak = int(power.argmax())
    found = []
    for step in (-1, 1):
        i = peak + step
        if not 0 <= i < len(power):
            found.append(peak)
            continue
        low, run, hit = i, 0, None
        while 0 <= i < len(power) and abs(freqs[i] - freqs[peak]) <= 1200:
            if soft[i] < soft[low]:
                low = i
            run = run + 1 if soft[i] <= floor * 1.12 else 0
            if run == 2:
                hit = i - step
                break
            i += step
        found.append(low if hit is None else hit)
    return floor, freqs[peak], freqs[found[0]], freqs[found[1]], power[peak]


@pytest.mark.parametrize(("n", "rate"), [(64, 24000.0), (480, 24000.0), (960, 48000.0), (20, 24000.0)])
def test_slice_features_equal_a_literal_walk(spark, n, rate):
    rng = np.random.default_rng(n)
    t = np.arange(n) / rate
    rows = [(i, (rng.normal(0, 1e-3, n) + np.sin(2 * np.pi * (3900 + 200 * i) * t) * rng.choice([0, 0.5])).tolist()) for i in range(40)]
    got = slices.with_features(spark.createDataFrame(rows, "id long, samples array<double>"), rate).collect()
    for r in got:
        want = slow_features(np.array(rows[r.id][1]), rate)
        assert (r.power_floor, r.dom_freq, r.left_freq, r.right_freq, r.dom_power) == pytest.approx(want, rel=1e-9)


def test_odd_slices(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0.0] * 8)], "id long, samples array<double>")
    got = {r.id: r for r in slices.with_features(df, 24000.0, keep_spectrum=True).collect()}
    assert got[1].dom_freq is None and got[2].freqs_band is None and got[3].dom_freq is not None
    assert slices.with_features(df.limit(0), 24000.0).count() == 0


def slow_dedupe(points, window, inclusive):
    points, out, i = [p for p in points if inclusive or p[1] > 0], [], 0
    while i < len(points):
        j = i + 1
        while j < len(points) and (points[j][0] - points[i][0] <= window if inclusive else points[j][0] - points[i][0] < window):
            j += 1
        out.append(max(points[i:j], key=lambda p: p[1]))
        i = j
    return out


@pytest.mark.parametrize("inclusive", [False, True])
def test_anchored_dedupe_equals_a_loop(spark, inclusive):
    rng = random.Random(3)
    rows = [(i, [(k / 8, float(rng.randint(0, 4))) for k in sorted(rng.sample(range(60), rng.randint(0, 20)))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, points array<struct<t:double,dom:double>>")
    got = slices.deduped_rate(df, 0.5, 0.02, inclusive).collect()
    for r in got:
        assert [tuple(p) for p in r.kept] == slow_dedupe(rows[r.id][1], 0.5, inclusive)


def test_labels_without_power_and_band_filter(spark):
    df = spark.createDataFrame([("a", 1, 0, 7000.0, 0.0), ("a", 1, 1, 5000.0, 0.0), ("b", 1, 0, 7000.0, 1.0), ("b", 1, 1, 7000.0, 0.04), ("b", 1, 2, None, None)], "audio_path string, detection_index long, slice_idx long, dom_freq double, dom_power double")
    got = {(r.audio_path, r.slice_idx): r.classification for r in slices.label_slices(df).collect()}
    assert got == {("a", 0): "Trill", ("a", 1): "Silence", ("b", 0): "Trill", ("b", 1): "Silence", ("b", 2): "Silence"}
    r = one(spark, x=slices.band_filter(F.array(*[F.lit(float(x)) for x in (3999, 4000, 12000, 12001)]), F.array(*[F.lit(float(x)) for x in range(4)])))
    assert [(x.freq, x.power) for x in r.x] == [(4000, 1), (12000, 2)]


def test_signal_helpers():
    rate, x = 8000, np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000) + np.sin(2 * np.pi * 3000 * np.arange(8000) / 8000)
    y = signal.bandpass(x, rate, 500, 1500)
    f, p = signal.power_spectra(y[None], rate)
    assert f[p[0].argmax()] == 1000 and p[0][3000] < 1e-4 * p[0][1000]
    assert signal.bandpass(x, rate, 0, 4000) is x and signal.bandpass(x, rate, 100, 100.5) is x
    f, t, p = signal.spectrogram(x, rate, 256, 192)
    assert p.shape == (129, len(t)) and p[32].mean() == pytest.approx(0.5, rel=0.1) and abs(t[0] - 0.016) < 1e-12
    assert signal.extract_slice(np.arange(5), -2, 4).tolist() == [0, 0, 0, 1] and signal.extract_slice(np.arange(5), 4, 3).tolist() == [4, 0, 0]
    m = signal.mask(np.arange(100.0).reshape(10, 10), [(0.1, 0.2, 0.2, 0.1)])
    assert (m[2, 1:3] == 49.5).all() and (m != np.arange(100.0).reshape(10, 10)).sum() == 2
    m = signal.mask(np.arange(100.0).reshape(10, 10), [(0.34, 0.0, 0.09, 1.0), (0.0, 0.0, 0.99, 0.1), (0.0, 0.95, 1.0, 0.04)])
    assert (m[:, 3] == 49.5).all() and (m[9] == 49.5).all() and (m == 49.5).sum() == 19
    for k in (1, 2, 3, 4, 5):
        a = np.random.default_rng(k).random((3, 9))
        assert np.allclose(signal.smoothed(a, k), [np.convolve(r, np.ones(k) / k, mode="same") for r in a])


def test_overrides_alone_are_broadcast(spark, tmp_path):
    """Metafiles of a file of a few bytes, whose candidates are far more rows than that looks like."""
    spark.range(2000).selectExpr("id as metafile", "concat('day ', id % 7, ' metafile.txt') as file", "'trip_metafile' as folder").write.parquet(str(tmp_path / "m"))
    metafiles = spark.read.parquet(str(tmp_path / "m"))
    overrides = spark.createDataFrame([("day 3", 2.5), ("trip", 4.0), ("never", 1.0)], "name string, seconds double").repartition(2)
    matched = matching.match_overrides(metafiles, overrides)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "Inner" not in plan
    assert {tuple(r) for r in matched.groupBy("name", "seconds").count().collect()} == {("day 3", 2.5, 286), ("trip", 4.0, 1714)}


def test_names_of_matched_overrides_are_joined_once(spark):
    overrides = spark.createDataFrame([("day", 2.5), ("never", 1.0)], "name string, seconds double")
    unused = matching.unused_overrides(overrides, spark.range(5000).selectExpr("id as metafile", "if(id % 2 = 0, 'day', 'night') as name"))
    assert "Aggregate [name" in unused._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in unused.collect()] == [("never", 1.0)]
