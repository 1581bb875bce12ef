"""Readers and writers on small files, the jobs end to end, and streams against batch."""

import gzip

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acoustics_spark.functions import signal
from acoustics_spark.jobs import characterise, clips, dataset, remap
from acoustics_spark.operators import detect, intervals, slices, windows
from acoustics_spark.sources import files, recordings, sinks
from acoustics_spark.streaming import events

RATE = 24000


def tone(seconds, bursts=(), hz=7000, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    x = np.random.default_rng(1).normal(0, 1e-3, len(t))
    for a, b in bursts:
        x += np.where((t >= a) & (t < b), 0.5 * np.sin(2 * np.pi * hz * t), 0)
    return x


@pytest.fixture(scope="module")
def wavs(tmp_path_factory):
    root = tmp_path_factory.mktemp("wavs")
    (root / "sub").mkdir()
    (root / "a.wav").write_bytes(files.wav_bytes(tone(8, [(2.0, 3.5), (6.0, 6.5)]), RATE))
    (root / "sub" / "b.WAV").write_bytes(files.wav_bytes(np.stack([tone(4, [(1, 2)]), np.zeros(4 * RATE)], 1), RATE))
    (root / "short.wav").write_bytes(files.wav_bytes(tone(1), RATE))
    (root / "my_Spacer.wav").write_bytes(files.wav_bytes(tone(5), RATE))
    (root / "bad.wav").write_bytes(b"RIFFxxxx")
    (root / "note.txt").write_text("no")
    return root


def name(path):
    return path.rsplit("/", 1)[-1]


def test_listing_and_headers(spark, wavs):
    got = {name(r.path) for r in files.list_recordings(spark, str(wavs), exclude="spacer").collect()}
    assert got == {"a.wav", "b.WAV", "short.wav", "bad.wav"}
    info = {name(r.path): r for r in files.recording_info(spark, str(wavs)).collect()}
    assert (info["a.wav"].samplerate, info["a.wav"].channels, info["a.wav"].frames, info["a.wav"].duration) == (RATE, 1, 8 * RATE, 8.0)
    assert info["b.WAV"].channels == 2 and info["bad.wav"].error and info["bad.wav"].frames is None


def test_windows_are_read_padded_and_mixed(spark, wavs):
    paths = {name(r.path): r.path for r in files.list_recordings(spark, str(wavs)).collect()}
    rows = [(paths["a.wav"], 7.5, 1.0, "x"), (paths["a.wav"], 9.0, 1.0, "y"), (paths["b.WAV"], 1.0, 0.5, "z"), (paths["a.wav"], 0.0, 0.1, "w")]
    asked = spark.createDataFrame(rows, "path string, window_start double, window_length double, tag string")
    got = {r.tag: np.array(r.samples) for r in files.load_windows(spark, asked, str(wavs)).collect()}
    a, b = tone(8, [(2.0, 3.5), (6.0, 6.5)]), tone(4, [(1, 2)])
    assert len(got["x"]) == RATE and (got["x"][RATE // 2 :] == 0).all() and np.allclose(got["x"][: RATE // 2], a[int(7.5 * RATE) :], atol=1e-4)
    assert (got["y"] == 0).all() and np.allclose(got["z"], b[RATE : RATE + RATE // 2] / 2, atol=1e-4)
    got = {r.tag: r.samples for r in files.load_windows(spark, asked, str(wavs), pad=False).collect()}
    assert got["y"] == [0.0] and len(got["x"]) == RATE // 2
    assert files.frame_range(0.1, 0.25, 10, "cover") == (1, 3) and files.frame_range(0.1, 0.25, 10, "span") == (1, 3) and files.frame_range(0.16, 0.25, 10, "nearest") == (2, 2)


def reference_slice(audio, rate, start, length, begin, end):
    """A slice of a segment, zeros outside it: frames counted from the segment's start."""
    begin, end = max(begin, 0.0), min(end, len(audio) / rate)
    first = round(begin * rate)
    segment, n, at = audio[first : first + round((end - begin) * rate)], round(length * rate), round((start - begin) * rate)
    return np.array([segment[at + i] if 0 <= at + i < len(segment) else 0.0 for i in range(n)])


def test_windows_are_padded_on_both_sides(spark, tmp_path):
    x = np.arange(1, 41) / 64
    (tmp_path / "x.wav").write_bytes(files.wav_bytes(x, 8))
    (path,) = [r.path for r in files.list_recordings(spark, str(tmp_path)).collect()]
    rows = [(path, start, length, a, b) for start in (-0.5, -0.25, 0.0, 0.3, 2.2, 4.5, 4.9, 5.5) for length in (0.25, 1.0) for a, b in ((-0.5, 9.0), (0.2, 3.1), (2.0, 2.5))]
    asked = spark.createDataFrame(rows, "path string, window_start double, window_length double, a double, b double")
    (r,) = [r for r in files.load_windows(spark, asked.filter("window_start = -0.25 and window_length = 1 and a = 2"), str(tmp_path)).collect()]
    assert np.allclose(np.array(r.samples) * 64, [0, 0, 1, 2, 3, 4, 5, 6], atol=0.01)
    got = {tuple(r)[:4]: r.samples for r in files.load_windows(spark, asked, str(tmp_path), rule="slice", segment=("a", "b")).select("window_start", "window_length", "a", "b", "samples").collect()}
    assert len(got) == len(rows)
    for _, start, length, a, b in rows:
        assert np.allclose(got[start, length, a, b], reference_slice(x, 8, start, length, a, b), atol=1e-3), (start, length, a, b)


def test_samples_are_read_by_ranges(spark, tmp_path, monkeypatch):
    x = tone(2, [(0, 2)])
    data = files.wav_bytes(x, RATE)
    junk = b"LIST" + (1 << 18).to_bytes(4, "little") + bytes(1 << 18)
    (tmp_path / "x y.wav").write_bytes(data[:36] + junk + data[36:])
    (r,) = files.recording_info(spark, str(tmp_path)).collect()
    assert (r.frames, r.error) == (2 * RATE, None)
    asked = spark.createDataFrame([(r.path, s, 0.5) for s in (0.0, 0.1, 1.25)], "path string, window_start double, window_length double")
    got = files.load_windows(spark, asked, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "CartesianProduct" not in plan
    for w in got.collect():
        a = int(w.window_start * RATE)
        assert np.allclose(w.samples, x[a : a + RATE // 2], atol=1e-4)
    monkeypatch.setattr(files, "AT_ONCE", 4000)
    frames = [(i * 100, 150, 0, 1000) for i in range(-3, 14)]
    blocks = list(files._blocks(frames, 2))
    assert sorted(i for _, _, held in blocks for i in held) == list(range(17)) and len(blocks) > 1
    for lo, hi, held in blocks:
        assert all(lo <= max(frames[i][0], 0) and min(frames[i][0] + 150, 1000) <= hi or not max(min(frames[i][0] + 150, 1000), 0) > max(frames[i][0], 0) for i in held)


def test_annotations_are_numbered_in_their_file(spark, tmp_path):
    head = ",".join(files.REQUIRED_ANNOTATIONS)
    lines = [f"s.wav,{'x' if i % 7 == 3 else 1},{i}.5,{i + 1}.5,9000,5000,c{i}," for i in range(1, 401)]
    (tmp_path / "a.csv").write_text("\n".join([head, *lines]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        good, bad = files.read_annotations(spark, str(tmp_path / "a.csv"))
        assert {r.row_index: r.lefttimesec for r in good.collect()} == {i: i + 0.5 for i in range(1, 401) if i % 7 != 3}
        assert sorted(r.row_index for r in bad.collect()) == [i for i in range(1, 401) if i % 7 == 3]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_metafiles_logs_and_tables(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one metafile.txt").write_text("\n AnnotationFile= l.log \r\na.wav\n\n spacer.wav\nb.wav\n")
    (tmp_path / "x" / "empty_metafile.txt").write_text("\n")
    (tmp_path / "x" / "no metafile.txt").write_text("a.wav\n")
    good, bad = files.parse_metafiles(files.read_metafiles(spark, str(tmp_path)))
    assert [(r.log_ref, r.pos, r.entry_name) for r in good.orderBy("pos").collect()] == [("l.log", 0, "a.wav"), ("l.log", 1, "spacer.wav"), ("l.log", 2, "b.wav")]
    assert {r.reason for r in bad.collect()} == {"empty", "no annotationfile line"}
    (tmp_path / "l.log").write_text("tag\ts\tc\tl\tr\tt\tb\tcomment\tnotes\nAN:\ts\t1\t0.5\t1.5\t9000\t5000\thi\tn\n ft: \ts\t1\tx\t1\t1\t1\tc\t\nzz:\t\t\t\t\t\t\t\t\nan:\ts\t1\t2\t3\t4\t5\n")
    good, bad = files.read_annotation_log(spark, str(tmp_path / "l.log"))
    assert [(r.channel, r.left, r.comment) for r in good.collect()] == [(1, 0.5, "hi")] and bad.count() == 2
    (tmp_path / "s.csv").write_text("FolderName,MetafileName,AnnotationFileName,AnnotationName\n a ,m,,n\n")
    assert [tuple(r) for r in files.read_signatures(spark, str(tmp_path / "s.csv")).collect()] == [("a", "m", "", "n", 1)]
    (tmp_path / "t.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_signatures(spark, str(tmp_path / "t.csv"))
    rows = spark.createDataFrame([("f", "m", "l", "n", "p", "s.wav", 1, 0.1234567, 2.0, 9000.0, 5000.0, "c", None)], "FolderName string, MetafileName string, AnnotationFileName string, AnnotationName string, AudioPath string, soundfile string, channel int, lefttimesec double, righttimesec double, topfreqhz double, bottomfreqhz double, comment string, notes string")
    sinks.write_annotations(rows, str(tmp_path / "ann"))
    good, bad = files.read_annotations(spark, str(tmp_path / "ann"))
    assert [(r.channel, r.lefttimesec) for r in good.collect()] == [(1, 0.123457)] and bad.count() == 0


def test_detection_and_label_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.wav", 0, 0.0, 3.0, 1, 0.5, 1.0, 0.5, 1.0, 2.0, 0.9), ("b/y.wav", 0, 0.0, 3.0, 1, 0.5, 1.0, 0.5, 1.0, 2.0, 0.9)], files.DETECTIONS)
    sinks.write_detections(rows, f"{tmp_path}/d")
    assert sorted(map(tuple, files.read_detections(spark, f"{tmp_path}/d").collect())) == sorted(map(tuple, rows.collect()))
    sinks.write_detections_by_recording(rows, f"{tmp_path}/r")
    assert {f"{p.parent.name}/{p.name}" for p in (tmp_path / "r").glob("*/recording=*")} == {"folder=a/recording=x", "folder=b/recording=y"}
    box = "array<struct<class_id:int,x_center:double,y_center:double,width:double,height:double>>"
    samples = spark.createDataFrame([("train", "s", [(0, 0.5, 0.25, 0.125, 1.0)]), ("val", "t", [])], f"split string, sample string, boxes {box}")
    sinks.write_labels(samples, f"{tmp_path}/l")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/l").collect()] == [("s", "0 0.500000 0.250000 0.125000 1.000000", "train")]
    sinks.write_dataset_stats(samples.groupBy("split").agg(F.count("*").alias("n")), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    clip = spark.createDataFrame([(tone(0.1, [(0, 0.1)]).tolist(), RATE, 100.0, 1000.0)], "samples array<float>, samplerate int, low double, high double")
    (r,) = sinks.filtered_clips(clip).collect()
    assert np.abs(r.samples[300:-300]).max() < 0.03


def test_detect_merge_and_characterise(spark, wavs):
    found, unusable = characterise.detections(spark, str(wavs), detect.band_energy_detector(), low=0.05)
    rows = sorted((name(r.audio_path), r.detection_index, round(r.start_time, 1), round(r.end_time, 1)) for r in found.collect())
    assert [r for r in rows if r[0] == "a.wav"] == [("a.wav", 1, 2.0, 3.5), ("a.wav", 2, 6.0, 6.5)] and ("b.WAV", 1, 1.0, 2.0) in rows
    assert {name(r.path) for r in unusable.collect()} == {"short.wav", "bad.wav"}
    labelled, stats = characterise.characterise(spark, found, str(wavs), RATE)
    got = {(name(r.audio_path), r.detection_index): r for r in stats.collect()}
    s = got["a.wav", 1]
    assert s.n_slices == 80 and 73 <= s.n_calls <= 78 and abs(np.median(s.dom_freqs) - 7000) < 100
    assert ("a.wav", 2) not in got
    plan = labelled._jdf.queryExecution().executedPlan().toString()
    reads = characterise.characterise(spark, spark.createDataFrame(found.collect(), found.schema), str(wavs), RATE)[0]._jdf.queryExecution().executedPlan().toString()
    assert "samples" not in plan.split("MapInArrow")[0] and reads.count("MapInArrow") == 1
    both = slices.trajectories(labelled)
    assert both.count() == len(got)


def test_spectrograms_and_masks(spark):
    x = spark.createDataFrame([(1, RATE, tone(1, [(0, 1)]).tolist())], "id long, samplerate int, samples array<float>")
    r = detect.with_spectrogram(x).first().spectrogram
    assert len(r.db) == len(r.freqs) == 513 and abs(r.freqs[int(np.argmax(np.array(r.db)[:, 3]))] - 7000) < 30 and r.low_db < r.high_db
    whole = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip((0, 0, 1, 1), ("x", "y", "width", "height"))])])
    masked = detect.with_spectrogram(x.withColumn("rectangles", whole)).first().spectrogram
    assert np.ptp(np.array(masked.db)) == 0
    flipped = detect.with_spectrogram(x.withColumn("flipped", F.lit(True))).first().spectrogram
    assert np.array_equal(np.array(flipped.db)[:, ::-1], np.array(r.db))


def test_dataset_samples_are_written_whole(spark, wavs, tmp_path):
    path = next(r.path for r in files.list_recordings(spark, str(wavs)).collect() if name(r.path) == "a.wav")
    rows = [(i, path, 0, 0.5 * i, 0.5 * i + 0.4, 6000.0, 8000.0, 8.0, RATE) for i in range(1, 14)]
    anchors = spark.createDataFrame(rows, "id long, path string, channel int, left double, right double, bottom double, top double, audio_duration double, samplerate int")
    plans = dataset.build(anchors, dataset.Plan(flip=True))
    counts = dataset.write(spark, plans, str(wavs), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sum(counts.values()) == len(got) == plans.count() and counts["flip"] == counts["drop"] == counts["mask"] > 0
    by = {r.sample: r for r in got}
    assert all(r["sample"].startswith("a_ann_000") and len(r.label.split("\n")) == len(r.boxes) > 0 and len(r.spectrogram.db) == 513 for r in got)
    assert {r.kind: len(r.rectangles) for r in got} == {"base": 0, "shift": 0, "shiftneg": 0, "flip": 0, "drop": 3, "mask": 2} or len({r.kind for r in got}) < 6
    for r in got:
        if r.derived:
            base = np.array(by[r["sample"].rsplit("__", 1)[0]].spectrogram.db, np.float32)
            own = np.array(r.spectrogram.db, np.float32)
            assert np.array_equal(own, base[:, ::-1]) if r.kind == "flip" else ((own != base) <= (own == np.median(base))).all() and (own != base).any()
    plan = dataset.samples(spark, plans, str(wavs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "a.wav").write_bytes(b"RIFFxxxx")
    moved = plans.withColumn("path", F.when(F.col("id") == 5, f"{broken}/a.wav").otherwise(F.col("path")))
    with pytest.raises(Exception):
        dataset.write(spark, moved, [str(wavs), str(broken)], f"{tmp_path}/failed")
    assert not list((tmp_path / "failed").rglob("part-*.parquet")) or not (tmp_path / "failed" / "_SUCCESS").exists()


def test_clips_of_annotations(spark, wavs):
    path = next(r.path for r in files.list_recordings(spark, str(wavs)).collect() if name(r.path) == "a.wav")
    columns = "AudioPath string, lefttimesec double, righttimesec double, topfreqhz double, bottomfreqhz double, stem string, global_index long"
    rows = [(path, 2.0, 3.5, 8000.0, 6000.0, "a", 1), (path, 2.0, 3.5, 3000.0, 1000.0, "a", 2), (path, 7.9, 8.0, 8000.0, 6000.0, "a", 3), (path, 9.0, 9.5, 1.0, 0.0, "a", 4), ("/none.wav", 0.0, 1.0, 1.0, 0.0, "n", 5)]
    found, rejects = clips.clips(spark, spark.createDataFrame(rows, columns), str(wavs), padding=0.5)
    got = {r.name: np.array(r.samples) for r in found.collect()}
    assert set(got) == {"a_ann_00001.wav", "a_ann_00002.wav", "a_ann_00003.wav"} and {r.global_index: r.reason for r in rejects.collect()} == {4: "outside the recording", 5: "no recording"}
    loud, quiet, last = (got[f"a_ann_0000{i}.wav"] for i in (1, 2, 3))
    assert len(loud) == 2.5 * RATE and len(last) == pytest.approx(0.6 * RATE, abs=1) and abs(np.abs(loud).max() - 0.5) < 0.05 and np.abs(quiet).max() < 0.05


def test_recordings_as_a_data_source(spark, wavs, tmp_path):
    recordings.register(spark)
    root = str(wavs)
    df = spark.read.format("recordings").option("path", f"{root};{tmp_path}/none").option("split", 100_000).load()
    rows = df.collect()
    bad = {name(r.path): r.error for r in rows if r.error}
    assert set(bad) == {"bad.wav", "none"} and "FileNotFoundError" in bad["none"]
    got = {(r.path, r.window_index): r for r in rows if not r.error}
    info = files.recording_info(spark, root).filter("error is null")
    grid = windows.expand_windows(windows.usable_recordings(info, 3.0)[0].select("path", "duration")).drop("duration", "window_end").withColumn("window_length", F.lit(3.0))
    want = {(r.path, r.window_index): r for r in files.load_windows(spark, grid, root).collect()}
    assert set(got) == set(want) and all(got[k].samples == want[k].samples and got[k].window_start == want[k].window_start for k in want)
    assert df.rdd.getNumPartitions() > 5
    one = next(k[0] for k in want if name(k[0]) == "a.wav")
    asked = df.filter((F.col("path") == one) & (F.col("window_start") >= 1.0) & (F.col("window_start") < 3.0))
    assert sorted(r.window_start for r in asked.select("window_start").collect()) == [1.0, 2.0] and asked.rdd.getNumPartitions() < 6
    assert df.filter("window_start > 4").filter("error is not null").count() == 0


def test_what_is_left_out_is_counted_in_the_same_pass(spark):
    rows = [(1.0, 2.0, 10.0), (2.0, 2.0, 10.0), (0.0, 5.0, 10.0), (1.0, 2.0, 2.0), (None, 1.0, 10.0), (1.0, 1.5, 10.0)]
    kept, seen = windows.counted_anchors(spark.createDataFrame(rows, "left double, right double, audio_duration double"), 3.0)
    assert len(kept.collect()) == 2 and seen.get == {"n": 6, "kept": 2, "not_positive": 2, "short_recording": 1, "too_long": 1}


def test_dataset_job(spark, sf):
    from acoustics_spark import fixtures

    samples = dataset.build(fixtures.anchors(spark, sf), dataset.Plan(flip=True)).cache()
    assert samples.count() == samples.select("sample").distinct().count()
    assert samples.filter("split <> 'train' and kind <> 'base'").count() == 0 and samples.filter("size(boxes) = 0").count() == 0
    counts = {r.kind: r["count"] for r in samples.filter("split = 'train'").groupBy("kind").count().collect()}
    assert counts["flip"] == counts["drop"] == counts["mask"] == counts["base"] + counts["shift"] + counts["shiftneg"]
    samples.unpersist()


@pytest.fixture
def deployment(tmp_path):
    """Two metafiles with spaces in their names, and one recording's name in both folders."""
    for folder, seconds in (("North site/day 1", 10), ("South+50%", 20)):
        at = tmp_path / folder
        at.mkdir(parents=True)
        (at / "a.wav").write_bytes(files.wav_bytes(np.zeros(seconds * 800), 800))
        (at / "b.wav").write_bytes(files.wav_bytes(np.zeros(10 * 800), 800))
        (at / "my spacer.wav").write_bytes(files.wav_bytes(np.zeros(3 * 800), 800))
        (at / "day metafile.txt").write_text("annotationfile=the log\na.wav\nmy spacer.wav\n..\\" + at.name + "\\b.wav\n")
        rows = [(1.0, "red bird"), (seconds + 6.5, "Blue bird"), (seconds + 1.0, "red"), (2.0, "nothing")]
        lines = [f"an:\ts\t0\t{left}\t{left + 1}\t9000\t5000\t{c}\t" for left, c in rows]
        (at / "the log").write_text("tag\ts\tc\tl\tr\tt\tb\tcomment\tnotes\n" + "\n".join([*lines, "an:\ts\t0\tx\t2\t9000\t5000\tbad\t"]) + "\n")
    (tmp_path / "South+50%" / "lost metafile.txt").write_text("annotationfile=the log\nnowhere.wav\n")
    (tmp_path / "South+50%" / "unlogged metafile.txt").write_text("annotationfile=none\na.wav\n")
    return tmp_path


def test_remap_from_files(spark, deployment):
    root = str(deployment)
    overrides = spark.createDataFrame([("day", 5.0)], "name string, seconds double")
    rows, rejects = remap.remap(spark, root, overrides=overrides)
    got = sorted((r.FolderName, r.MetafileName, r.AnnotationFileName, r.AudioPath, r.soundfile, r.lefttimesec, r.global_index, r.AnnotationName) for r in rows.collect())
    want = []
    for k, folder in enumerate(("North site/day 1", "South+50%")):
        for i, (sound, left, comment) in enumerate([("a.wav", 1.0, "red bird"), ("b.wav", 1.5, "Blue bird"), ("a.wav", 2.0, "nothing")]):
            want.append((folder, "day metafile", "the log", f"{root}/{folder}/{sound}", sound if i != 1 else f"..\\{folder.split('/')[-1]}\\b.wav", left, 3 * k + i + 1, comment))
    assert got == sorted(want)
    assert sorted((name(r.metafile), r.reason) for r in rejects.collect()) == sorted(
        2 * [("day metafile.txt", "starts in my spacer.wav"), ("day metafile.txt", "bad value in row 5")]
        + [("lost metafile.txt", "bad value in row 5"), ("lost metafile.txt", "recording nowhere.wav: missing"), ("unlogged metafile.txt", "annotation log not found")]
    )
    rows, _ = remap.remap(spark, root, spacer_recordings=True)
    assert [(r.AudioPath[-5:], r.lefttimesec) for r in rows.filter("FolderName = 'South+50%' and comment = 'Blue bird'").collect()] == [("b.wav", 3.5)]


def test_remap_by_signatures(spark, deployment):
    root, columns = str(deployment), "folder string, meta string, log string, name string, seq long"
    signatures = spark.createDataFrame([("South+50%", "day metafile.txt", "the log", "sig_red", 1), ("South+50%", "day metafile.txt", "the log", "sig-blue_bird", 2), ("Elsewhere", "x", "y", "z", 3)], columns)
    rows, rejects = remap.remap(spark, root, signatures)
    got = sorted((r.FolderName, r.comment, r.AnnotationName, r.lefttimesec) for r in rows.collect())
    assert got == [("South+50%", "red bird", "sig_red", 1.0)]  # of the rest one has no name, the others start in or before the spacer of 55.125 s
    assert {r.reason for r in rejects.collect()} == {"starts in my spacer.wav", "bad value in row 5"}
    rows, rejects = remap.remap(spark, root, signatures.withColumn("log", F.lit("gone")))
    assert rows.count() == 0 and [r.reason for r in rejects.collect()] == ["annotation log not found"]
    remap.remap_to_csv(spark, root, f"{root}/out.csv", signatures=signatures)
    good, bad = files.read_annotations(spark, f"{root}/out.csv")
    assert [(r.FolderName, r.soundfile, r.lefttimesec) for r in good.collect()] == [("South+50%", "a.wav", 1.0)] and bad.count() == 0


def test_logs_have_line_numbers_and_signatures_an_order(spark, tmp_path):
    (tmp_path / "a b.log").write_text("h\t\t\t\t\t\t\t\t\n" + "".join(f"{'an:' if i % 2 else 'zz:'}\ts\t1\t{i}\t{i + 1}\t9\t5\tc\t\n" for i in range(1, 300)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    try:
        good, _ = files.read_annotation_log(spark, str(tmp_path))
        assert {r.line_no: r.left for r in good.collect()} == {i: float(i) for i in range(1, 300, 2)}
        assert {r.log_path for r in good.collect()} == {f"{tmp_path}/a b.log"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    (tmp_path / "s.csv").write_text("FolderName,MetafileName,AnnotationFileName,AnnotationName\n" + "".join(f"f,m,l,n{i}\n" for i in range(1, 50)))
    assert [r.name for r in files.read_signatures(spark, str(tmp_path / "s.csv")).orderBy("seq").collect()] == [f"n{i}" for i in range(1, 50)]


STREAM = "audio_path string, start_ts timestamp, duration double, low_freq double, high_freq double, confidence double"


def drain(df, table, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(table).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(table)


def batches(spark, tmp_path, rows, schema, parts=2):
    folder = str(tmp_path / "in")
    for i in range(parts):
        spark.createDataFrame(rows[i::parts] if parts > 1 else rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_stream_merge_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    base = 1_700_000_000
    spans = [(p, float(s), float(d)) for p in "ab" for s, d in zip(rng.integers(0, 400, 60) / 4, rng.integers(0, 8, 60) / 4)]
    rows = [(p, s, d, 1.0, 2.0, 0.5) for p, s, d in spans]
    schema = STREAM.replace("start_ts timestamp", "s double")
    folder = batches(spark, tmp_path, rows + [(p, 1e5, 1.0, 1.0, 2.0, 0.5) for p in "ab"], schema)
    stream = spark.readStream.schema(schema).parquet(folder).withColumn("start_ts", F.timestamp_seconds(F.col("s") + base))
    got = drain(events.merge_stream(stream, "1000 seconds"), "merged")
    got = {(r.audio_path, r.a - base, r.b - base) for r in got.select("audio_path", F.unix_micros("start_ts").alias("a"), F.unix_micros("end_ts").alias("b")).selectExpr("audio_path", "a / 1e6 AS a", "b / 1e6 AS b").collect()}
    table = [(p, 0, 0.0, 1.0, i, s, s + max(d, 1e-6), d, 1.0, 2.0, 0.5) for i, (p, s, d) in enumerate(spans)]
    want = intervals.merge_overlapping(spark.createDataFrame(table, files.DETECTIONS)).collect()
    assert {(a, round(s, 5), round(e, 5)) for a, s, e in got} == {(r.audio_path, round(r.start_time, 5), round(r.end_time, 5)) for r in want}


def test_stream_window_counts_and_ingest(spark, tmp_path):
    rows = [("a", float(s), 1.0, 1.0, 2.0, s / 10) for s in (0, 1, 2, 2, 5)] + [("a", 1000.0, 1.0, 1.0, 2.0, 0.0)]
    schema = STREAM.replace("start_ts timestamp", "s double")
    folder = batches(spark, tmp_path, rows, schema, 1)
    stream = spark.readStream.schema(schema).parquet(folder).withColumn("start_ts", F.timestamp_seconds("s"))
    got = {F_(r.window_start): (r.n, r.confidence) for r in drain(events.window_counts(stream, "10 seconds"), "counts").collect()}
    assert got[0] == (4, 0.2) and got[-2] == (1, 0.0) and got[3] == (1, 0.5)
    whole = spark.createDataFrame([("a", 0.0)], "audio_path string, s double").select("audio_path", F.timestamp_seconds("s").alias("start_ts"))
    whole.write.parquet(f"{tmp_path}/new")
    for _ in range(2):
        events.ingest(spark, f"{tmp_path}/new", whole.schema, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def F_(ts):
    import datetime

    return int((ts - datetime.datetime(1970, 1, 1)).total_seconds())


def test_stream_dedupe_equals_batch_in_any_order(spark, tmp_path):
    rng = np.random.default_rng(2)
    points = {(p, k): sorted((float(t) / 8, float(d)) for t, d in zip(rng.choice(200, 50, replace=False), rng.integers(0, 5, 50))) for p in "ab" for k in (1, 2)}
    rows = [(p, k, t, d) for (p, k), own in points.items() for t, d in own]
    rng.shuffle(rows)
    rows = [(str(p), int(k), float(t), float(d)) for p, k, t, d in rows]
    schema = "audio_path string, detection_index long, t double, dom double"
    folder = batches(spark, tmp_path, rows, schema, 3)
    spark.createDataFrame([("a", 1, 1e5, 1.0)], schema).coalesce(1).write.mode("append").parquet(folder)
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.option("maxFilesPerTrigger", 1).schema(schema).parquet(folder).withColumn("ts", F.timestamp_seconds("t"))
        got = sorted((r.audio_path, r.detection_index, r.t, r.dom) for r in drain(events.dedupe_stream(stream, "30 seconds", 0.5), "kept").collect() if r.t < 1e4)
    finally:
        spark.conf.set(key, old)
    df = spark.createDataFrame([(*k, own) for k, own in points.items()], "audio_path string, detection_index long, points array<struct<t:double,dom:double>>")
    assert got == sorted((r.audio_path, r.detection_index, k.t, k.dom) for r in slices.deduped_rate(df, 0.5).collect() for k in r.kept)


def test_recordings_that_arrive_are_written_once(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in" / "x y").mkdir(parents=True)
    run = lambda: events.ingest_recordings(spark, folder, lambda batch: characterise.detections(spark, batch, detect.band_energy_detector(), low=0.05)[0], out, checkpoint).awaitTermination()
    def found():
        return sorted((r.folder, r.recording, r.batch, round(float(r.start_time), 1)) for r in spark.read.option("header", True).csv(out).collect())

    (tmp_path / "in" / "x y" / "a.wav").write_bytes(files.wav_bytes(tone(8, [(2.0, 3.5), (6.0, 6.5)]), RATE))
    run()
    assert found() == [("x_y", "a", 0, 2.0), ("x_y", "a", 0, 6.0)]
    (tmp_path / "in" / "b.wav").write_bytes(files.wav_bytes(tone(4, [(1, 2)]), RATE))
    run()
    run()
    want = [("-", "b", 1, 1.0), ("x_y", "a", 0, 2.0), ("x_y", "a", 0, 6.0)]
    assert found() == want
    for name in ("commits/1", "commits/.1.crc"):  # as if the second batch had failed after its write
        (tmp_path / "cp" / name).unlink(missing_ok=True)
    run()
    assert found() == want


def test_zero_phase_filter(spark):
    t = np.arange(RATE) / RATE
    for low, high, hz in ((4000, 5000, 4500), (6000, 8000, 7000)):
        y = signal.bandpass(np.sin(2 * np.pi * hz * t), RATE, low, high)
        assert abs(np.abs(y[RATE // 4 : -RATE // 4]).max() - 1) < 1e-9
    w = np.linspace(1e-3, np.pi - 1e-3, 400)
    z, analog = np.exp(-1j * w), 4 * np.tan(w / 2)
    for low, high in ((0, 0.3), (0.2, 1), (0.33, 0.42), (0.01, 0.9)):
        gain = np.prod([np.abs((b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2)) for b0, b1, b2, _, a1, a2 in signal.butterworth(4, low, high)], axis=0)
        down, up = 4 * np.tan(np.pi * low / 2), 4 * np.tan(np.pi * min(high, 0.999) / 2)
        x = analog / up if low == 0 else down / analog if high == 1 else (analog**2 - down * up) / ((up - down) * analog)
        assert np.allclose(gain, 1 / np.sqrt(1 + x**8), atol=1e-9)
    x = np.random.default_rng(0).normal(size=(3, 700))
    y = signal.bandpass(x, RATE, 4000, 5000)
    assert np.allclose(signal.bandpass(np.ones(500), RATE, 0, 3000), 1)
    sections = signal.butterworth(4, 4000 / 12000, 5000 / 12000)
    want = []
    for row in x:  # sample by sample
        edge = 3 * (2 * len(sections) + 1)
        out = [2 * row[0] - v for v in row[edge:0:-1]] + list(row) + [2 * row[-1] - v for v in row[-2 : -edge - 2 : -1]]
        for _ in range(2):
            level = out[0]
            for b0, b1, b2, _, a1, a2 in sections:
                g = (b0 + b1 + b2) / (1 + a1 + a2)
                s1, s2, made = (g - b0) * level, (b2 - a2 * g) * level, []
                for v in out:
                    u = b0 * v + s1
                    s1, s2 = b1 * v - a1 * u + s2, b2 * v - a2 * u
                    made.append(u)
                out, level = made, level * g
            out = out[::-1]
        want.append(out[edge:-edge])
    assert np.allclose(y, want, atol=1e-12) and np.array_equal(signal.bandpass(x, RATE, 0, 12000), x)


def test_files_of_a_deployment_are_opened_once(spark, deployment):
    """Readers' results are held, as several joins ask for them; plans behind them don't go back to the files."""
    root = str(deployment)
    rows, rejects = remap.remap(spark, root)
    for df in (rows, rejects):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" not in plan and "MapInArrow" not in plan


def test_clips_are_turned_one_at_a_time(spark, monkeypatch):
    """However many there are in a batch, a task holds AT_ONCE bytes of recordings."""
    monkeypatch.setattr(sinks, "AT_ONCE", 1000)
    clips = spark.range(9, numPartitions=1).selectExpr("concat('c', id) as name", "transform(sequence(1, 200 + id), i -> i / 1000D) as samples", "8000 as samplerate")
    got = sinks.clip_files(clips)
    sizes = got.mapInArrow(lambda batches: (pa.record_batch([pa.array([len(b)])], names=["n"]) for b in batches), "n long")
    assert sizes.agg({"n": "sum"}).first()[0] == 9
    want = {f"c{i}": files.wav_bytes(np.arange(1, 201 + i) / 1000, 8000) for i in range(9)}
    assert {r.path: bytes(r.content) for r in got.collect()} == want


def test_the_driver_holds_no_listing_of_a_deployment(spark, deployment):
    """Tasks list folders, and open metafiles and logs by the listing; the results are those of Spark's readers."""
    root = str(deployment)
    for i in range(40):
        at = deployment / f"more {i % 5}" / "deep"
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{i}.wav").write_bytes(b"x")
    for skipped in (".hidden", "_temporary", "empty.wav"):
        (deployment / "more 1" / skipped).write_bytes(b"x" if skipped != "empty.wav" else b"")
    by_spark = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    listing = files.list_files(spark, root)
    assert sorted(map(tuple, listing.collect())) == sorted((r.path.removeprefix("file:"), r.length) for r in by_spark.select("path", "length").collect())
    assert listing.count() == 52 and not any(root in path for path in listing.inputFiles())
    assert files.list_files(spark, [f"{root}/more 1", f"{root}/more 1/deep"], "*[13].wav").count() == 4
    assert files.list_files(spark, f"{root}/more 1", recursive=False).count() == 0
    metafiles = files.read_metafiles(spark, listing)
    assert not any(root in path for path in metafiles.inputFiles())
    assert sorted(map(tuple, metafiles.collect())) == sorted(map(tuple, files.read_metafiles(spark, root).collect()))
    with pytest.raises(Exception, match="FileNotFoundError"):
        files.list_files(spark, f"{root}/nowhere")


@pytest.mark.parametrize("block", [1 << 25, 61])
def test_logs_of_a_listing_are_read_as_by_sparks_reader(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(files, "BLOCK", block)
    monkeypatch.setattr(files, "CHUNK", 7 if block == 61 else files.CHUNK)
    head, rows = b"tag\ts\tc\tl\tr\tt\tb\tcomment\tnotes", [b"%s\ts\t1\t%d\t9\t9\t5\tc\t" % (b"an:" if i % 3 else b"zz:", i) for i in range(60)]
    rows[4:11] = [b"", b" \t ", b"an:\ts", b'an:\ts\t1\t1\t2\t3\t4\t"a\tb ""c"\tn\tmore', "ft:\ts\t1\t1\t2\t3\t4\té \x85\x0cü\t".encode(), b"an:\ts\t1\t1\t2\t3\t4\t\xff\tn", b'"open\t1']
    for i, end in enumerate((b"\n", b"\r\n", b"\r", b"\n\r\n")):
        (tmp_path / f"log {i}+%").write_bytes(end + end.join([head, *rows]))
    (tmp_path / "log.gz").write_bytes(gzip.compress(b"\xef\xbb\xbf" + b"\n".join([head, *rows]) + b"\n"))
    found = [files.read_annotation_log(spark, x, recursive=True) for x in (files.list_files(spark, str(tmp_path)), str(tmp_path))]
    for got, want in zip(*found):
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and got.count() >= 5
