import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlab.config import CLASS_NAMES, AugmentConfig, EvalConfig, LossConfig
from rasterlab.functions import arrays as A, keyed
from rasterlab.operators import augment as AU, infer as IN, losses as L, metrics as M, postproc as PP, prep as P, scenes as SC
from rasterlab.plans import queries as Q
from rasterlab.sources import files as S
from rasterlab.sources.packed import explode_channels, explode_pixels, pack_pixels, packed, tile_image

RNG = np.random.default_rng(3)


def samples(spark, n=20, size=16):
    rows = []
    for i in range(n):
        labels = RNG.choice([0, 1, 2, 3, 4], (size, size), p=[0.9, 0.03, 0.03, 0.01, 0.03]).astype(np.uint8)
        rows.append((i, size, size, packed(RNG.random((size, size))), labels.tobytes()))
    return spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary, labels binary")


def confusion(spark, cells):
    return spark.createDataFrame(cells, "true_class int, pred_class int, n long")


def png(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + pixels[i].tobytes() for i in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def dataset(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    for part, n in (("train", 20), ("test", 3)):
        (root / part / "images").mkdir(parents=True)
        (root / part / "labels_1D").mkdir()
        for i in range(n):
            (root / part / "images" / f"img_{i:04d}.jpg").write_bytes(png(np.full((6, 7), i * 10, np.uint8)))
            mask = np.full((6, 7), i % 7, np.uint8)
            mask[0, 0] = 255
            (root / part / "labels_1D" / f"img_{i:04d}.png").write_bytes(png(mask))
    return root


def test_load_dataset(spark, dataset):
    data, weights, batches = P.load_dataset(spark, str(dataset), "train", P.DataConfig(batch_size=4, size=5))
    rows = data.collect()
    assert {(r.height, r.width, len(r.pixels), len(r.labels)) for r in rows} == {(5, 5, 200, 25)}  # patches of one size
    order = lambda **k: {r.image_id: (r.batch_id, r.top, r.left) for r in P.load_dataset(spark, str(dataset), "train", P.DataConfig(batch_size=4, size=5), drop_remainder=False, **k)[0].collect()}
    first = order()
    assert len(first) == 17 and first == order() and first != order(epoch=1)
    assert [first[k][0] for k in sorted(first)] != sorted(x[0] for x in first.values())  # shuffled
    assert batches == 5 and len(rows) == 16 and sorted({r.batch_id for r in rows}) == [0, 1, 2, 3]
    assert max(max(r.labels) for r in rows) <= 4
    assert abs(weights.agg(F.sum("weight")).first()[0] - 1) < 1e-9
    val, none, batches = P.load_dataset(spark, str(dataset), "val", P.DataConfig(size=8))
    assert none is None and batches == 1 and [r.height for r in val.collect()] == [8, 8, 8]
    assert P.load_dataset(spark, str(dataset), "test", P.DataConfig(size=8))[0].count() == 3
    with pytest.raises(ValueError):
        P.load_dataset(spark, str(dataset), "other")


def test_unreadable_files(spark, dataset, tmp_path):
    (tmp_path / "a.png").write_bytes(png(np.zeros((2, 2), np.uint8)))
    (tmp_path / "b.png").write_bytes(b"junk")
    assert S.scan_masks(spark, str(tmp_path), on_error="drop").count() == 1
    kept = {r.image_id: r.error for r in S.scan_masks(spark, str(tmp_path), on_error="quarantine").collect()}
    assert kept == {"a": None, "b": "unreadable"}
    with pytest.raises(Exception, match="unreadable"):
        S.scan_masks(spark, str(tmp_path)).collect()


def test_class_weight_cache(spark, tmp_path):
    weights = spark.createDataFrame([(0, 10, 1.0, 1.0)], "class_id int, pixel_count long, freq double, weight double")
    path = str(tmp_path / "w")
    assert S.read_class_weights(spark, path) is None
    S.write_class_weights(weights, path, 3, 10)
    assert S.read_class_weights(spark, path, 3, 10).count() == 1
    assert S.read_class_weights(spark, path, 4, 10) is None


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "train", 0, i // 4) for i in range(10)], "image_id long, split string, epoch int, batch_id int")
    S.write_samples(df, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
    total = confusion(spark, [(0, 0, 5), (0, 1, 5), (1, 1, 5)])
    S.write_class_iou_csv(M.compare_runs(total, total), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).columns == ["Class", "IoU_TTA", "IoU_baseline", "Improvement"]
    report = S.render_report(M.summary(total), M.class_report(total))
    assert "| Sea Surface | 50.00 | 100.00 | 50.00 | 66.67 |" in report


def test_positions_pair_only_equal_counts(spark):
    a = spark.createDataFrame([("x/1.jpg",), ("x/2.jpg",)], "path string")
    with pytest.raises(ValueError):
        S.pair_samples(a, a.limit(1), "position")


def test_packed_and_long_agree(spark):
    df = samples(spark)
    long = explode_pixels(df, {"pixels": "<f8"}).withColumnRenamed("pixels", "v")
    again = {r.image_id: r.pixels for r in pack_pixels(long.repartition(7)).collect()}
    assert again == {r.image_id: r.pixels for r in df.collect()}
    assert tile_image(df, 8, halo=1).count() == 80


def test_class_counts_of_both_forms(spark):
    df = samples(spark)
    long = explode_pixels(df, {"labels": "u1"})
    assert P.class_distribution(df).collect() == P.class_distribution_long(long, "labels").collect()


def test_patches(spark):
    df = samples(spark)
    cut = P.sample_patches(df, 8).collect()
    assert all(r.height == 8 and len(r.labels) == 64 and 0 <= r.top <= 8 for r in cut)
    again = {r.image_id: r.labels for r in P.sample_patches(df.repartition(5), 8).collect()}
    assert again == {r.image_id: r.labels for r in cut}
    for r in cut:
        if r.centred:
            assert {1, 3} & set(r.labels)
    assert P.sample_patches(df, 32).first().height == 32


def test_plans_do_not_depend_on_partitions(spark):
    df = samples(spark, 200).select("image_id", "height", "width")
    a = sorted(AU.augmentation_plan(df).collect())
    assert a == sorted(AU.augmentation_plan(df.repartition(9)).collect())
    other = sorted(AU.augmentation_plan(df, epoch=1).collect())
    assert a != other


def test_draw_rates(spark):
    plan = AU.augmentation_plan(spark.range(4000).selectExpr("id AS image_id", "64 AS height", "64 AS width"))
    row = plan.selectExpr("avg(int(flip_h)) a", "avg(int(flip_v)) b", "avg(int(quarter > 0)) c", "avg(int(speckle)) d", "avg(int(sigma is not null)) e", "max(size(patches)) f", "min(angle) g", "max(angle) h").first()
    for got, wanted in zip(row[:5], (0.5, 0.3, 0.2, 0.7, 0.2), strict=True):
        assert abs(got - wanted) < 0.04
    assert row.f == 3 and row.g >= -AugmentConfig().max_rotation and row.h <= AugmentConfig().max_rotation


def test_augment(spark):
    df = samples(spark, 60)
    out = {r.image_id: r for r in AU.augment(df).collect()}
    again = {r.image_id: r for r in AU.augment(df.repartition(3)).collect()}
    assert all(out[i].pixels == again[i].pixels for i in out)
    values = np.concatenate([np.frombuffer(r.pixels) for r in out.values()])
    assert values.min() >= 0 and values.max() <= 1
    only = AU.augment(df, AugmentConfig(0, 0, 0, 0, 0.15, 1, 0, 0.2, 0, (0.8, 1.2), 0, (0.7, 1.5), 0, (0.5, 1.5), 0))
    before = np.concatenate([np.frombuffer(r.pixels) for r in sorted(df.collect())])
    after = np.concatenate([np.frombuffer(r.pixels) for r in sorted(only.collect())])
    ratio = (after / np.maximum(before, 1e-9))[(after > 0) & (after < 1) & (before < 0.6)]
    assert abs(ratio.mean() - 1) < 0.02 and abs(ratio.std() - 0.15) < 0.02
    batches = AU.apply_augmentation(df, 16).groupBy("batch_id").count().collect()
    assert sorted(r["count"] for r in batches) == [16, 16, 16]


def test_augment_equals_its_plan_step_by_step(spark):
    """Without noise, every image follows from its plan by plain array operations; turned images aren't rotated too."""
    from rasterlab.functions import kernels

    df = samples(spark, 80)
    cfg = AugmentConfig(p_speckle=0.0)
    before = {r.image_id: r for r in df.collect()}
    turned = 0
    for r in AU.augment(df, cfg, keep_plan=True).collect():
        image, mask = np.frombuffer(before[r.image_id].pixels).reshape(16, 16), np.frombuffer(before[r.image_id].labels, np.uint8).reshape(16, 16)
        if r.flip_h:
            image, mask = image[:, ::-1], mask[:, ::-1]
        if r.flip_v:
            image, mask = image[::-1], mask[::-1]
        if r.quarter:
            turned += 1
            image, mask = np.rot90(image, r.quarter), np.rot90(mask, r.quarter)
        else:
            image, mask = kernels.rotate(image, r.angle), kernels.rotate(mask, r.angle, nearest=True)
        image = image + (r.delta or 0.0)
        image = np.clip((image - image.mean()) * (1.0 if r.factor is None else r.factor) + image.mean(), 0, 1)
        image = image if r.gamma is None else np.maximum(image, 1e-7) ** r.gamma
        image = image if r.sigma is None else kernels.blur(image, r.sigma)
        image = image.copy()
        for p in r.patches or []:
            image[p.top : p.top + p.h, p.left : p.left + p.w] = 0
        assert np.allclose(np.frombuffer(r.pixels).reshape(16, 16), np.clip(image, 0, 1), atol=1e-9)
        assert np.array_equal(np.frombuffer(r.labels, np.uint8).reshape(16, 16), mask)
    assert 5 < turned < 40


def test_multi_scale_predict_equals_one_image_at_a_time(spark):
    """Batched calls, against a plain loop over scales and variants; channels are averaged, bytes brought to [0, 1]."""
    from rasterlab.functions import kernels

    shapes = []

    def predict(batch):
        shapes.append(batch.shape)
        assert batch.shape[-1] == 1
        x = batch[..., 0]
        return np.stack([x, 1 - x, x * x, x.mean(axis=(1, 2), keepdims=True) + 0 * x, np.sqrt(np.abs(x))], axis=-1)

    images = {0: RNG.random((8, 8)), 1: RNG.random((8, 8)), 2: RNG.random((12, 9)), 3: RNG.random((8, 8)) * 255, 4: RNG.random((8, 8, 3))}
    rows = [(i, x.shape[0], x.shape[1], packed(x)) for i, x in images.items()]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary")
    got = {r.image_id: np.frombuffer(r.probs).reshape(r.height, r.width, 5) for r in IN.multi_scale_predict(df, lambda: predict, (0.5, 1.0)).collect()}
    for i, x in images.items():
        x = x.mean(axis=-1) if x.ndim == 3 else x
        x = x / 255 if x.max() > 1 else x
        total = 0
        for s in (0.5, 1.0):
            small = kernels.resize_bilinear(kernels.resize_bilinear(x, IN.scaled_size(x.shape[0], s), IN.scaled_size(x.shape[1], s)), *x.shape)
            p = [kernels.softmax(IN.backward(predict(IN.forward(small, k, a, z, x.shape)[None, ..., None])[0], k, a, x.shape)) for k, a, z in IN.variant_list()]
            total = total + kernels.softmax(np.log(np.clip(np.mean(p, axis=0), IN.LOW, IN.HIGH)))
        assert np.allclose(got[i], np.clip(total / 2, IN.LOW, IN.HIGH), atol=1e-9), i
    assert IN.model_input(np.ones((2, 2, 3, 1)), 3).shape == (2, 2, 3, 3)


def test_one_bad_image_costs_no_other(spark):
    def predict(batch):
        if (batch > 0.99).any():
            raise RuntimeError("bad")
        return np.repeat(batch, 5, axis=-1)

    bright = np.zeros((8, 8))
    bright[2:6, 2:6] = 1.0
    rows = [(0, 8, 8, packed(np.full((8, 8), 0.3))), (1, 8, 8, packed(bright))]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary").coalesce(1)
    got = {r.image_id: r for r in IN.multi_scale_predict(df, lambda: predict, (1.0,), tta=False, on_error="quarantine").collect()}
    assert got[0].probs is not None and got[0].error is None and got[1].probs is None and got[1].error


def test_lovasz_with_nearly_all_errors_in_one_place(spark):
    """A good model's errors are tiny and alike; the global order must hold whatever the buckets."""
    p = 1e-7 + RNG.random(4000) ** 8 * 1e-3
    rows = [(int(t), [float(1 - 4 * x) if c == t else float(x) for c in range(5)]) for t, x in zip(RNG.integers(0, 5, 4000), p, strict=True)]
    df = spark.createDataFrame(rows, "true_class int, probs array<double>").withColumn("image_id", F.lit(1)).repartition(4)
    one = L.lovasz_softmax(df, by=["image_id"]).first().loss
    for buckets in (1, 16, 128):
        assert L.lovasz_softmax(df, buckets=buckets).first().loss == pytest.approx(one, abs=1e-12)


def test_variants():
    assert [v[0] for v in IN.variant_list()] == ["original", "h_flip", "v_flip", "h_flip_v_flip", "rotate", "rotate", "rotate", "rotate"]
    assert len(IN.variant_list(8, scales=True)) == 8 and IN.variant_list(1) == [("original", None, None)]
    assert [IN.scaled_size(384, s) for s in (0.5, 0.75, 1.0, 1.25, 1.5)] == [192, 288, 384, 480, 576]
    image = RNG.random((8, 8))
    for kind in ("original", "h_flip", "v_flip", "h_flip_v_flip", "other"):
        there = IN.forward(image, kind, None, None, (8, 8))
        assert np.allclose(IN.backward(there, kind, None, (8, 8)), image)


def test_failed_variants(spark):
    def make():
        def predict(batch):
            raise RuntimeError("no")

        return predict

    df = samples(spark, 2)
    rows = IN.multi_scale_predict(df, make, on_error="quarantine").collect()
    assert [r.probs for r in rows] == [None, None] and rows[0].error
    with pytest.raises(Exception, match="no"):
        IN.multi_scale_predict(df, make).collect()


def test_metrics_by_hand(spark):
    total = confusion(spark, [(0, 0, 6), (0, 1, 2), (1, 1, 2), (1, 2, 2)])  # 2 is predicted but absent in the truth
    iou = {r.class_id: r.iou for r in M.class_iou(total).collect()}
    assert iou == {0: 0.75, 1: pytest.approx(2 / 6), 2: 0.0}
    assert M.mean_iou(total).first().miou == pytest.approx((0.75 + 1 / 3) / 2)
    assert M.mean_iou(total, "union").first().miou == pytest.approx((0.75 + 1 / 3) / 3)
    prf = {r.class_id: r for r in M.precision_recall_f1(total).collect()}
    assert prf[1].precision == 0.5 and prf[1].recall == 0.5 and prf[2].f1 == 0.0
    assert M.pixel_accuracy(total).first().accuracy == pytest.approx(8 / 12)
    perfect = confusion(spark, [(0, 0, 9)])
    assert M.cohens_kappa(perfect).first().kappa == 1.0
    empty = confusion(spark, [])
    assert M.cohens_kappa(empty).first().kappa == 0.0 and M.mean_iou(empty).first().miou == 0.0


def test_published_means_agree():
    from rasterlab.config import BASELINE_IOU

    assert abs(sum(BASELINE_IOU) / 5 - 65.06) < 0.03  # the published mean; the class values are rounded
    assert len(CLASS_NAMES) == 5


def test_bootstrap(spark):
    rows = [(i, t, p, int(n)) for i in range(60) for t, p, n in zip((0, 0, 1, 1), (0, 1, 1, 0), RNG.integers(1, 50, 4), strict=True)]
    per = spark.createDataFrame(rows, "image_id long, true_class int, pred_class int, n long")
    point = M.mean_iou(M.total_confusion(per)).first().miou
    spread = {}
    for mode in ("exact", "poisson"):
        reps = M.bootstrap_replicates(per, 200, mode)
        low, high = M.bootstrap_ci(reps).first()
        assert low < point < high
        spread[mode] = high - low
    assert abs(spread["exact"] - spread["poisson"]) < 0.4 * spread["exact"]


def test_losses_by_hand(spark):
    rows = [(0, 0, 0, 0, [1.0, 0.0]), (0, 0, 1, 1, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, true_class int, probs array<double>")
    assert L.lovasz_softmax(df).first().loss == pytest.approx(0.0)
    wrong = df.withColumn("probs", F.reverse("probs"))
    assert L.lovasz_softmax(wrong).first().loss == pytest.approx(1.0)
    assert L.hybrid_dice(df, None, num_classes=2).first().loss == pytest.approx(0.0, abs=1e-6)
    assert L.hybrid_focal(df, None, LossConfig(smoothing=0.0), num_classes=2).first().loss == pytest.approx(0.0, abs=1e-6)
    same = spark.createDataFrame([(0, 0, i, i % 2, [0.5, 0.5]) for i in range(8)], df.schema)
    a = L.lovasz_softmax(same).first().loss
    assert a == pytest.approx(L.lovasz_softmax(same.orderBy(F.desc("x")), by=["image_id"]).first().loss)


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],)], "v array<double>")
    row = df.select(A.argmax("v").alias("a"), A.softmax("v").alias("s")).first()
    assert row.a == 1 and sum(row.s) == pytest.approx(1.0)


def test_draws_are_uniform(spark):
    row = spark.range(5000).select(keyed.uniform("x", "id").alias("u")).selectExpr("avg(u)", "min(u)", "max(u)").first()
    assert abs(row[0] - 0.5) < 0.02 and row[1] >= 0 and row[2] < 1


def test_log_input_equals_probabilities(spark):
    probs = np.full((8, 8, 5), 0.1)
    probs[2:6, 2:6, 3] = 0.6
    df = spark.createDataFrame([(0, 8, 8, packed(probs), packed(np.log(probs)))], "image_id long, height int, width int, probs binary, logs binary")
    a = np.frombuffer(PP.ship_enhancement(df).first().probs)
    b = np.frombuffer(PP.ship_enhancement(df, column="logs", kind="log").first().logs)
    assert np.allclose(a, b)


def test_accumulator_reads_resets_and_restarts(spark, tmp_path):
    """Events out of order over three runs of the query, against a loop; nulls and foreign classes count nowhere; a row
    that the watermark has passed is dropped."""
    from rasterlab.streaming.accumulate import accumulated, stream_accumulator

    schema = "source string, s long, kind string, true_class int, pred_class int"
    base, rows = 1_700_000_000, []
    for i in range(400):
        kind = RNG.choice(["count", "read", "reset"], p=[0.9, 0.06, 0.04])
        rows.append((["hot", "hot", "a", "b"][i % 4], base + 10 * (i + int(RNG.integers(0, 20))), str(kind), int(RNG.integers(0, 5)), int(RNG.integers(0, 5))))
    rows = [("hot", base + 500, "reset", None, None), ("hot", base + 500, "read", None, None), ("hot", base + 500, "count", 1, 2)] * 2 + rows  # equal times
    odd = [(None, base + 5, "count", 1, 1), ("hot", None, "count", 1, 1), ("hot", base + 5, None, 1, 1), ("hot", base + 5, "count", None, 1), ("hot", base + 5, "count", 7, 1), ("hot", base + 5, "other", 1, 1)]
    late = [("hot", base, "count", 0, 0)]
    last = [("end", base + 20_000, "count", 0, 0)]
    source = str(tmp_path / "in")

    def run(part):
        spark.createDataFrame(part, schema).selectExpr("source", "timestamp_seconds(s) ts", "kind", "true_class", "pred_class").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("source string, ts timestamp, kind string, true_class int, pred_class int").parquet(source)
        out = stream_accumulator(stream, "300 seconds", salts=3)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    run(rows[:200] + odd)
    run(rows[200:])
    run(late + last)
    got = {(r.source, r.s, r.kind, r.generation, r.true_class, r.pred_class): r.n for r in accumulated(spark.read.parquet(str(tmp_path / "out"))).selectExpr("*", "unix_seconds(ts) s").collect()}
    wanted = {}
    for name in ("hot", "a", "b"):
        counts, generation = {}, 0
        for _, s, kind, t, p in sorted((r for r in rows if r[0] == name), key=lambda r: (r[1], ["count", "read", "reset"].index(r[2]))):
            if kind == "count":
                counts[t, p] = counts.get((t, p), 0) + 1
                continue
            for cell, n in counts.items():
                at = (name, s, kind, generation, *cell)
                wanted[at] = wanted.get(at, 0) + n
            counts, generation = ({}, generation + 1) if kind == "reset" else (counts, generation)
    assert got == wanted and len(got) > 100


def test_packed_losses_equal_the_long_form(spark):
    """Images of different sizes; ranges cut into many parts and runs of one image each; layouts, reductions, weights."""
    from rasterlab.operators import packed_losses as PL

    rows = []
    for i, (h, w) in enumerate([(8, 8), (5, 9), (8, 8), (1, 1), (12, 3), (8, 8)]):
        truth = RNG.integers(0, 4, (h, w)).astype(np.uint8)  # class 4 doesn't occur
        probs = RNG.dirichlet(np.ones(5), (h, w)).round(2)
        rows.append((i, h, w, truth.tobytes(), probs.tobytes()))
    rows.append((6, 8, 8, rows[0][3], rows[0][4]))  # a repeated image
    df = spark.createDataFrame(rows, "image_id int, height int, width int, labels binary, probs binary").repartition(3).persist()
    long = explode_pixels(df, {"labels": "u1"}).withColumnRenamed("labels", "true_class").join(explode_channels(df, "probs", 5).withColumnRenamed("values", "probs"), ["image_id", "y", "x"]).persist()
    whole = L.lovasz_softmax(long).first().loss
    for pixels in (1, 7, PL.RANGE_PIXELS):
        assert PL.lovasz_packed(df, range_pixels=pixels).first().loss == pytest.approx(whole, abs=1e-12)
    each = {r.image_id: r.loss for r in L.lovasz_softmax(long, by=["image_id"]).collect()}
    got = {r.image_id: r.loss for r in PL.lovasz_of_images(df).collect()}
    assert got == pytest.approx(each, abs=1e-12) and len(got) == 7
    for weights, cfg, layout, reduction in (([0.05, 0.25, 0.2, 0.4, 0.1], LossConfig(lovasz=0.5), "planes", "mean"), (None, LossConfig(smoothing=0.0), "reference", "reference")):
        a = PL.hybrid_loss_packed(df, weights, cfg, layout=layout, reduction=reduction).first().asDict()
        b = L.hybrid_loss(long, df, weights, cfg, layout=layout, reduction=reduction).first().asDict()
        assert a == pytest.approx(b, abs=1e-9)
    nothing = df.limit(0)
    assert PL.lovasz_packed(nothing).first().loss == 0.0 and PL.lovasz_of_images(nothing).count() == 0
    assert PL.hybrid_loss_packed(nothing, None).first().ce is None
    # no pixel becomes a row: a run for each task, class and range of errors
    runs = PL.error_runs(df).persist()
    assert runs.agg(F.sum("n")).first()[0] == 5 * long.count() and runs.select("class_id", "bucket", F.spark_partition_id()).distinct().count() == runs.count()


def test_every_inventory_group_has_queries():
    assert set(Q.ORACLES) <= set(Q.QUERIES)
    groups = {
        "sources": "pair_samples_stem pair_samples_position orphans select_split explode_pixels pack_pixels tile_image write_class_iou_csv write_read_class_weights write_read_samples",
        "preparation": "split_train_val clip_labels class_distribution class_distribution_long class_weights normalise_pixels auto_rescale fix_channels resize_bilinear resize_nearest pad_to_patch class_presence sample_target_pixel class_centred_crop random_crop patch_plan sample_patches assign_batches shuffle_epoch epoch_places epoch_batch",
        "augmentation": "flip_h flip_v rotate_bilinear rotate_nearest speckle brightness contrast gamma gaussian_blur cutout augmentation_plan augment apply_augmentation map_samples",
        "inference": "tta_variants scale_variants augment_variant reverse_variant predict_images softmax fuse_tta fuse_scales argmax_class argmax_labels match_prediction_size multi_scale_predict predict_large_images",
        "post-processing": "class_mask morph_open morph_close connected_components component_stats filter_components dilate_small boost_and_suppress ship_enhancement scene_components scene_blur scene_sobel scene_dilate_small scene_ship_enhancement",
        "metrics": "confusion_matrix confusion_packed confusion_per_image class_iou mean_iou_truth mean_iou_union precision_recall_f1 pixel_accuracy frequency_weighted_iou cohens_kappa bootstrap_replicates bootstrap_replicates_split bootstrap_ci evaluate evaluate_with_interval class_report compare_to_baseline compare_runs",
        "losses": "one_hot smooth_labels pixel_weight weighted_cross_entropy focal_loss dice_loss sobel_edges boundary_loss hybrid_ce hybrid_focal hybrid_dice lovasz_softmax lovasz_of_images lovasz_softmax_global lovasz_softmax_global_long hybrid_loss hybrid_loss_long",
        "streaming": "stream_confusion stream_windowed_iou stream_class_distribution stream_joined_confusion stream_accumulator",
    }
    for group, names in groups.items():
        assert not set(names.split()) - set(Q.QUERIES), group


def test_registered_bootstrap_has_the_production_size(spark, monkeypatch):
    rows = [(i, t, p, int(n)) for i in range(6) for t, p, n in zip((0, 0, 1, 1), (0, 1, 1, 0), RNG.integers(1, 50, 4), strict=True)]
    per = spark.createDataFrame(rows, "image_id long, true_class int, pred_class int, n long").persist()
    monkeypatch.setattr(Q, "_per_image", lambda spark, sf: per)
    assert Q.bootstrap_replicates(spark, "").count() == EvalConfig.bootstrap
    assert Q.bootstrap_replicates_poisson(spark, "").count() > 0.98 * EvalConfig.bootstrap  # a replicate without an image has no row
    values = [r.miou for r in Q.bootstrap_replicates(spark, "").collect()]
    ci = Q.bootstrap_ci(spark, "").first()
    assert np.allclose((ci.ci_low, ci.ci_high), np.percentile(values, (2.5, 97.5)), atol=2e-6)


def scene_tiles(spark, images: dict, size: int, name: str, dtype: str):
    rows = [(i, *x.shape[:2], packed(x, dtype)) for i, x in images.items()]
    df = spark.createDataFrame(rows, f"image_id long, height int, width int, {name} binary")
    return tile_image(df, size, 0, dtype, name).withColumnRenamed("pixels", name)


def joined_scenes(tiles, name: str, dtype: str, shapes: dict) -> dict:
    out = {i: np.zeros(s, dtype) for i, s in shapes.items()}
    for r in tiles.collect():
        part = np.frombuffer(r[name], dtype)
        out[r.image_id][r.top : r.top + r.height, r.left : r.left + r.width] = part.reshape(r.height, r.width, *shapes[r.image_id][2:])
    return out


@pytest.mark.parametrize("size", [3, 8, 64])
def test_scene_filters_equal_whole_images(spark, size):
    """Tiles smaller than the halo, tiles cut off at the edges, a scene of one tile."""
    from rasterlab.functions import kernels

    images = {1: RNG.random((21, 30)), 2: RNG.random((9, 7)), 3: RNG.random((1, 2))}
    shapes = {i: x.shape for i, x in images.items()}
    tiles = SC.store_tiles(scene_tiles(spark, images, size, "pixels", "<f8"))
    got = joined_scenes(SC.scene_blur(tiles, 0.9, size), "pixels", "<f8", shapes)
    assert all(np.allclose(got[i], kernels.blur(x, 0.9), atol=1e-12) for i, x in images.items())
    got = joined_scenes(SC.scene_sobel(tiles, size, "pixels"), "pixels", "<f8", shapes)
    assert all(np.allclose(got[i], kernels.sobel(x), atol=1e-12) for i, x in images.items())
    masks = {i: x > 0.45 for i, x in images.items()}
    tiles = scene_tiles(spark, masks, size, "mask", "u1")
    for made, kernel in ((SC.scene_open(tiles, size), kernels.morph_open), (SC.scene_close(tiles, size), kernels.morph_close), (SC.scene_open(tiles, size, 5), lambda m: kernels.morph_open(m, 5))):
        got = joined_scenes(made, "mask", "u1", shapes)
        assert all((got[i] == kernel(m)).all() for i, m in masks.items())


def test_scene_ship_enhancement_equals_whole_images(spark):
    """Ships of every size class over tile borders; a scene without a ship stays."""
    images = {}
    for i in range(4):
        probs = RNG.dirichlet([8, 2, 2, 0.5, 2], (33, 26))
        ship = np.zeros((33, 26), bool)
        for top, left, h, w in ((2, 2, 3, 4), (12, 6, 6, 8), (20, 1, 11, 12), (5, 20, 2, 2))[: 4 - i]:
            ship[top : top + h, left : left + w] = True
        if i < 3:
            probs[ship] = [0.1, 0.05, 0.15, 0.6, 0.1]
        else:
            probs[..., 3] = np.minimum(probs[..., 3], 0.2)
        images[i] = probs
    shapes = {i: x.shape for i, x in images.items()}
    whole = spark.createDataFrame([(i, 33, 26, packed(x)) for i, x in images.items()], "image_id long, height int, width int, probs binary")
    wanted = {r.image_id: np.frombuffer(r.probs).reshape(shapes[r.image_id]) for r in PP.ship_enhancement(whole).collect()}
    got = joined_scenes(SC.scene_ship_enhancement(scene_tiles(spark, images, 8, "probs", "<f8"), 8), "probs", "<f8", shapes)
    for i in images:
        assert np.allclose(got[i], wanted[i], atol=1e-12)
    assert (got[3] == images[3]).all() and not np.allclose(got[0], images[0], atol=1e-3)


def test_stored_tiles_are_not_shuffled_and_holes_are_errors(spark):
    tiles = SC.store_tiles(scene_tiles(spark, {1: RNG.random((16, 16))}, 8, "pixels", "<f8"))
    plan = SC.scene_blur(tiles, 0.9, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "ShuffledHashJoin" in plan  # the strips alone
    assert SC.border_strips(tiles, {"pixels": "<f8"}, 8, 2).where("ty < 2 and tx < 2").selectExpr("sum(aggregate(strips, 0L, (a, s) -> a + length(s.pixels)))").first()[0] == 8 * 4 * (2 * 8 * 2 + 4)
    with pytest.raises(Exception, match="full grid"):
        SC.scene_blur(tiles.where("not (ty = 0 and tx = 1)"), 0.9, 8).collect()


def test_model_calls_hold_many_images_of_real_size_over_batch_borders(spark, tmp_path):
    """Sixteen or more images of 384 x 384 in a call, in a worker below 2 GB; Arrow batches have three images here."""
    log = str(tmp_path / "calls")

    def make():
        def predict(batch):
            import resource

            with open(log, "a") as f:
                print(batch.shape[0], batch.shape[1], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, file=f)
            return -40.0 * (batch - np.array([0.5, 0.25, 0.35, 0.88, 0.68])) ** 2

        return predict

    sides = [384, 384, 384, 384, 64, 100] * 6
    rows = [(i, s, s, packed(np.full((s, s), 0.01 * i))) for i, s in enumerate(sides)]
    df = spark.createDataFrame(rows, "image_id long, height int, width int, pixels binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = IN.multi_scale_predict(df, make, (1.0,)).selectExpr("image_id", "height", "length(probs) as n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.image_id: (r.height, r.n) for r in got} == {i: (s, 40 * s * s) for i, s in enumerate(sides)}
    calls = [tuple(map(int, x.split())) for x in open(log)]
    large = [n for n, side, _ in calls if side == 384]
    assert max(large) >= 16 and sum(large) == 24 * 8 and max(m for *_, m in calls) < 2_000_000
    assert [n for n, side, _ in calls if side == 64] == [6] * 8


def test_queue_bounds_what_waits(monkeypatch):
    monkeypatch.setattr(IN, "QUEUE_BYTES", 1000)
    queue = IN.SizeQueue(4, 5)
    image = lambda i, side: {"image_id": i, "height": side, "width": side, "pixels": b"x" * (8 * side * side)}
    out = [g for i in range(30) for g in queue.add(image(i, 1 + i % 5))]
    assert queue.waiting <= 1000
    out += list(queue.rest())
    assert queue.waiting == 0 and sorted(r["image_id"] for g in out for r in g) == list(range(30))
    assert all(len(g) <= 4 and len({r["height"] for r in g}) == 1 for g in out) and max(map(len, out)) > 1
    queue = IN.SizeQueue(4, 5, score_bytes=8 * 5 * 100)
    assert queue.room((10, 10, 800)) == 1 and queue.room((5, 5, 200)) == 4 and queue.room((100, 100, 80_000)) == 1


def test_single_precision_scores_are_close(spark):
    df = samples(spark, 9, 24).select("image_id", "height", "width", "pixels")
    model = lambda: lambda x: -40.0 * (x - np.array([0.5, 0.25, 0.35, 0.88, 0.68], x.dtype)) ** 2
    one = {r.image_id: np.frombuffer(r.probs) for r in IN.multi_scale_predict(df, model, (0.5, 1.0)).collect()}
    two = {r.image_id: np.frombuffer(r.probs) for r in IN.multi_scale_predict(df, model, (0.5, 1.0), dtype="<f4").collect()}
    assert len(one) == 9 and all(np.allclose(one[i], two[i], atol=2e-5) for i in one)


def test_fuse_takes_any_number_of_classes(spark):
    p = RNG.dirichlet(np.ones(7), (4, 3))
    rows = [(1, 0, x, v, p[v, x].tolist()) for v in range(4) for x in range(3)]
    df = spark.createDataFrame(rows, "image_id long, y int, x int, variant int, probs array<double>")
    got = {r.x: r.fused for r in IN.fuse_tta(df).collect()}
    assert all(len(v) == 7 and np.allclose(v, np.log(p[:, x].mean(axis=0))) for x, v in got.items())
    with pytest.raises(Exception, match="7 classes were expected, not 5"):
        IN.fuse_tta(df.union(spark.createDataFrame([(1, 0, 0, 9, [0.2] * 5)], df.schema))).collect()


def test_errors_keep_what_the_model_said(spark):
    def make():
        def predict(batch):
            raise RuntimeError("out of tokens")

        return predict

    rows = IN.multi_scale_predict(samples(spark, 2), make, on_error="quarantine").collect()
    assert {r.error for r in rows} == {"RuntimeError: out of tokens"}


def test_split_draws_have_the_distribution_of_draws():
    """Counts of 6 images in 6 draws: binomial each, all of them together always 6, equal whatever the way to them."""
    n, replicates = 6, 40_000
    draws = M.SplitDraws(n, replicates, 1)
    times = np.stack([draws.times(i) for i in range(n)])
    assert (times.sum(axis=0) == n).all()
    wanted = [np.prod([(n - j) / (j + 1) for j in range(k)]) * (1 / n) ** k * (1 - 1 / n) ** (n - k) for k in range(n + 1)]
    for row in times:
        assert np.allclose(np.bincount(row, minlength=n + 1) / replicates, wanted, atol=0.01)
    covariance = np.cov(times)
    assert np.allclose(np.diag(covariance), 1 - 1 / n, atol=0.03) and np.allclose(covariance[~np.eye(n, dtype=bool)], -1 / n, atol=0.03)
    both = ((times[0] == 1) & (times[4] == 2)).mean()  # a joint probability of the multinomial
    assert both == pytest.approx(60 * (1 / 6) ** 3 * (4 / 6) ** 3, abs=0.006)
    other = M.SplitDraws(n, replicates, 1)
    for i in (4, 0, 5, 2, 1, 3, 0):
        assert (other.times(i) == times[i]).all()
    assert (M.SplitDraws(1, 3, 1).times(0) == 1).all()


def test_split_bootstrap_is_the_same_under_any_partitioning(spark):
    rows = [(i, t, p, int(n)) for i in range(300) for t, p, n in zip((0, 0, 1, 1), (0, 1, 1, 0), RNG.integers(1, 50, 4), strict=True)]
    per = spark.createDataFrame(rows, "image_id long, true_class int, pred_class int, n long")
    a, b = ({r.replicate: r.miou for r in M.bootstrap_replicates(per.repartition(k), 50, "split").collect()} for k in (1, 13))
    assert a == b and len(a) == 50
    exact = [r.miou for r in M.bootstrap_replicates(per, 400).collect()]
    split = [r.miou for r in M.bootstrap_replicates(per, 400, "split").collect()]
    assert np.mean(split) == pytest.approx(np.mean(exact), abs=4 * np.std(exact) / 14) and np.std(split) == pytest.approx(np.std(exact), rel=0.2)
    plan = M.bootstrap_replicates(per, 50, "split")._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (" not in plan  # no row per draw


def test_positions_without_rdd_or_window_over_all_rows(spark):
    names = [f"{c}{i}" for i in range(200) for c in "aÄz"] + ["same"] * 50 + [None, ""]
    df = spark.createDataFrame([(x, i % 5) for i, x in enumerate(names)], "path string, k int").repartition(7)
    got = S.position(df).collect()
    assert sorted(r.position for r in got) == list(range(len(names)))
    order = sorted(names, key=lambda x: (x is not None, (x or "").encode()))
    assert [r.path for r in sorted(got, key=lambda r: r.position)] == order
    assert S.position(df.limit(0)).count() == 0 and S.position(df).columns == ["path", "k", "position"]
    plan = S.position(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


@pytest.mark.parametrize("n", [1, 2, 3, 5, 97, 400, 401, 3001])
def test_permutation_is_a_bijection_with_its_inverse(spark, n):
    rows = spark.range(n).select("id", keyed.permuted(F.col("id"), n, seed=5, epoch=2).alias("p"))
    rows = rows.select("id", "p", keyed.permuted(F.col("p"), n, seed=5, epoch=2, inverse=True).alias("back"), keyed.permuted(F.col("id"), n, seed=5, epoch=3).alias("other")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)
    if n > 90:
        p = np.array([r.p for r in rows])
        assert sum(r.p == r.other for r in rows) < 10 and (p == np.arange(n)).sum() < 10
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.3


def test_epoch_batches_cover_the_epoch(spark):
    placed = spark.range(50).withColumnRenamed("id", "position")
    place = {r.position: r.place for r in P.epoch_places(placed, 50, 7, 1).collect()}
    batches = [P.epoch_batch(spark, 50, 16, b, 7, 1).collect() for b in range(4)]
    assert [len(b) for b in batches] == [16, 16, 16, 2]
    assert {r.position: r.place for b in batches for r in b} == place


def test_joined_streams_restart_and_repeat_without_counting_twice(spark, tmp_path):
    """Masks first, predictions after a restart; an epoch given to the sink again changes nothing; late pairs stay out."""
    from rasterlab.streaming.monitor import stream_joined_confusion
    from rasterlab.streaming.sinks import EpochSink

    base = 1_700_000_000
    masks, preds = RNG.integers(0, 5, (2, 12, 16), dtype=np.uint8)
    for i in range(12):
        late = 7200 if i in (3, 9) else 60
        spark.createDataFrame([(i, base + i, masks[i].tobytes())], "image_id long, s long, labels binary").selectExpr("image_id", "timestamp_seconds(s) ts", "labels").coalesce(1).write.mode("append").parquet(str(tmp_path / f"masks{i // 6}"))
        spark.createDataFrame([(i, base + i + late, preds[i].tobytes())], "image_id long, s long, preds binary").selectExpr("image_id", "timestamp_seconds(s) ts", "preds").coalesce(1).write.mode("append").parquet(str(tmp_path / f"preds{i // 6}"))
    seen = []
    sink = EpochSink(str(tmp_path / "epochs"))
    assert sink.totals(spark).count() == 0

    def run():
        a = spark.readStream.schema("image_id long, ts timestamp, labels binary").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "a"))
        b = spark.readStream.schema("image_id long, ts timestamp, preds binary").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "b"))

        def each(batch, epoch):
            batch.persist()
            seen.append(epoch)
            sink(batch, epoch)
            sink(batch, epoch)  # as after a failure

        stream_joined_confusion(a, b, each, str(tmp_path / "state"), watermark="3 hours").trigger(availableNow=True).start().awaitTermination()

    def move(name, to):
        import shutil

        (tmp_path / to).mkdir(exist_ok=True)
        for f in (tmp_path / name).glob("part-*.parquet"):
            shutil.move(f, tmp_path / to / f.name)

    def wanted(ids):
        n = np.bincount(np.concatenate([masks[i].astype(int) * 5 + preds[i] for i in ids]), minlength=25)
        return {(c // 5, c % 5): int(x) for c, x in enumerate(n) if x}

    got = lambda: {(r.true_class, r.pred_class): r.n for r in sink.totals(spark).collect()}
    move("masks0", "a"), move("masks1", "a"), move("preds0", "b")
    run()
    assert got() == wanted([0, 1, 2, 4, 5])
    first = list(seen)
    move("preds1", "b")
    run()
    assert got() == wanted([0, 1, 2, 4, 5, 6, 7, 8, 10, 11]) and min(seen[len(first) :]) > max(first)


UNFINISHED = ["scene_blur", "scene_dilate_small", "scene_ship_enhancement", "scene_sobel"]


@pytest.fixture(scope="module")
def unfinished(tmp_path_factory):
    """Tiles whose scenes lack some: at the end, at the start and in the middle."""
    import duckdb
    import pandas as pd

    root = tmp_path_factory.mktemp("unfinished")
    ids = pd.DataFrame({"vec_id": [i for i in range(75) if i != 21] + list(range(1103, 1179))})  # noqa: F841
    duckdb.sql(f"COPY (SELECT vec_id, [CAST(0.5 * sin(vec_id + i * i * 0.05) AS FLOAT) FOR i IN range(64)] AS embedding FROM ids) TO '{root}/embeddings.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", UNFINISHED)
def test_unfinished_scenes_equal_sql(spark, unfinished, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{unfinished}/embeddings.parquet'")
    wanted = con.execute(Q.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    wanted = sorted(wanted.fetchall())
    assert sorted(tuple(r) for r in Q.QUERIES[name](spark, unfinished).select(*columns).collect()) == wanted and len(wanted) >= 150 * 64


def test_accumulator_with_equal_times_equals_sql(spark, tmp_path):
    """Reads and resets of a monitor at the same time, and reads in the same second."""
    import duckdb

    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i // 6 * 400) MILLISECOND + INTERVAL (CASE WHEN i > 5900 THEN 6 ELSE 0 END) HOUR AS ts, CAST(8 * (i % 3) + i // 6 % 2 AS BIGINT) AS user_id,
        ['click', 'error', 'purchase', 'signup', 'view', 'purchase', 'signup'][CAST(hash(i // 3) % 7 + 1 AS INTEGER)] AS event_type, CAST(hash(i) % 100 AS DOUBLE) AS value FROM range(6000) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    wanted = con.execute(Q.ORACLES["stream_accumulator"])
    columns = [c[0] for c in wanted.description]
    wanted = sorted(wanted.fetchall())
    got = sorted(tuple(r) for r in Q.stream_accumulator(spark, str(tmp_path)).select(*columns).collect())
    assert got == wanted and len(wanted) > 1000


def test_small_images_are_handled_in_bounded_steps(spark, monkeypatch):
    """A batch of many small rows is never turned into arrays or objects as a whole."""
    import pyarrow as pa

    from rasterlab.plans import fixtures
    from rasterlab.sources.packed import STEP_ROWS, steps

    class Caught:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    monkeypatch.setattr(fixtures, "table", lambda *_: Caught())
    n = 3000
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(RNG.normal(0, 0.2, n * 64).astype(np.float32)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), vectors], names=["vec_id", "embedding"])
    assert max(p.num_rows for p in steps(batch)) <= STEP_ROWS
    made = list(fixtures.packed_tiles(spark, "")(iter([batch])))
    assert max(b.num_rows for b in made) <= STEP_ROWS and [i for b in made for i in b["image_id"].to_pylist()] == list(range(n))
    images = {i: RNG.random((1 + i % 5, 1 + i % 3)) for i in range(700)} | {700: RNG.random((300, 301))}
    rows = spark.createDataFrame([(i, *x.shape, packed(x)) for i, x in images.items()], "image_id long, height int, width int, pixels binary").coalesce(1)
    got = {(r.image_id, r.y, r.x): r.pixels for r in explode_pixels(rows, {"pixels": "<f8"}).collect()}
    assert got == {(i, y, x): v for i, a in images.items() for (y, x), v in np.ndenumerate(a)}
