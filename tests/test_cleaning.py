"""Column expressions."""

import pytest
from pyspark.sql import functions as F

from concord.functions import cleaning, fixed_values, paths, rules, vectors
from concord.sources import files


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_errors_and_sentinels(spark):
    rows = [("cat",), ("Error",), ("an Error_Processing",), (None,)]
    got = one(spark, rows, "x string", cleaning.null_errors(F.col("x")), cleaning.null_exact(F.col("x"), "Error"))
    assert got == [("cat", "cat"), (None, None), (None, "an Error_Processing"), (None, None)]


def test_numbers(spark):
    rows = [("1.5",), ("—",), ("x",), (" 2 ",), (None,)]
    assert one(spark, rows, "x string", cleaning.to_number(F.col("x"))) == [(1.5,), (None,), (None,), (2.0,), (None,)]


def test_strip_text(spark):
    texts = ["\t a b \r\n", "  x　", "\x1cq\x85", "", "   "]
    got = one(spark, [(t,) for t in texts], "x string", cleaning.strip_text(F.col("x")))
    assert [r[0] for r in got] == [t.strip() for t in texts]


def test_ratios(spark):
    rows = [(6.0, 3.0), (6.0, 0.0), (6.0, -1.0)]
    got = one(spark, rows, "n double, d double", cleaning.safe_ratio(F.col("n"), F.col("d")))
    assert got == [(2.0,), (0.0,), (0.0,)]
    assert one(spark, [(4.0,), (0.0,)], "m double", cleaning.per_second(F.col("m"))) == [(250.0,), (0.0,)]


def test_texts(spark):
    got = one(spark, [(7, "Vision: a/b-c_d é", 1.0, 0.25)], "n int, t string, m double, s double",
              cleaning.safe_name(F.col("n"), F.col("t")), cleaning.mean_std_text(F.col("m"), F.col("s")),
              cleaning.short_label(F.col("t"), 6))
    assert got == [("07_Vision_ a_b-c_d é", "1.00 ± 0.25", "Vision")]
    wide = one(spark, [(123, "x" * 80)], "n int, t string", cleaning.safe_name(F.col("n"), F.col("t")))
    assert wide == [("123_" + "x" * 60,)]


def test_paths(spark):
    rows = [("E:\\a\\b\\x.jpg",), ("/data/cat/sub/y.JPG",), ("noparent.png",), ("/data/.hidden",), ("/data/cat/z",)]
    got = one(spark, rows, "p string", paths.parent_folder(F.col("p")), paths.extension(F.col("p")),
              paths.first_folder(F.col("p"), "/data"))
    assert got == [
        ("b", ".jpg", None),
        ("sub", ".JPG", "cat"),
        ("Unknown", ".png", None),
        ("data", "", None),
        ("cat", "", "cat"),
    ]


def test_extension_filter(spark):
    df = spark.createDataFrame([("a.JPG",), ("b.png",), ("c.txt",)], "path string")
    assert [r[0] for r in files.with_extension(df, "path", [".jpg", ".png"]).collect()] == ["a.JPG", "b.png"]
    assert [r[0] for r in files.with_extension(df, "path", [".jpg", ".png"], case_sensitive=True).collect()] == ["b.png"]


def test_ground_truth_prefers_columns(spark):
    df = spark.createDataFrame([("/d/cat/x.jpg", "dog")], "filepath string, label string")
    assert files.with_ground_truth(df).first()["ground_truth"] == "dog"
    assert files.with_ground_truth(df.drop("label")).first()["ground_truth"] == "cat"


@pytest.mark.parametrize(
    "name, family",
    [
        ("ResNet50", "CNNs"),
        ("ConvNeXt-Tiny", "CNNs"),
        ("Swin-T", "Transformers"),
        ("CLIP (ViT-B/32)", "Transformers"),  # vit is tested before clip
        ("SigLIP", "Vision-Language"),
        ("mystery", "Other"),
    ],
)
def test_families(spark, name, family):
    assert one(spark, [(name,)], "x string", rules.keyword_family(F.col("x"))) == [(family,)]


@pytest.mark.parametrize(
    "name, config, kind",
    [
        ("google-siglip-base", None, "siglip"),
        ("openai-clip-vit", None, "clip"),
        ("mobilevit-small", None, "unknown"),
        ("vit-base", None, "vit"),
        ("folder", '{"model_type": "ResNet", "architectures": ["X"]}', "resnet"),
        ("folder", '{"architectures": ["CLIPModel"]}', "clip"),
        ("folder", '{"model_type": "mobilevit", "architectures": ["ViT"]}', "unknown"),
        ("folder", "not json", "unknown"),
        ("folder", None, "unknown"),
    ],
)
def test_model_type(spark, name, config, kind):
    got = one(spark, [(name, config)], "n string, c string", rules.rule_label(F.col("n"), F.col("c")))
    assert got == [(kind,)]


def test_alias_lookup(spark):
    rows = [("ResNet-50",), ("Res_Net50",), ("EfficientNetB0",), ("Swin-T",)]
    got = one(spark, rows, "x string", rules.lookup_normalised(F.col("x"), fixed_values.BACKBONE_ALIASES))
    assert got == [("resnet50.a1_in1k",), ("resnet50.a1_in1k",), ("efficientnet_b0.ra_in1k",), ("swin-t",)]


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],)]
    v = F.col("v")
    assert one(spark, rows, "v array<float>", vectors.l2_normalize(v)) == [([0.6, 0.8],), (None,)]
    assert one(spark, [([1.0, 5.0, 5.0],)], "v array<float>", vectors.argmax(v), vectors.argmax_label(v, {1: "one"}),
               vectors.argmax_label(v, {0: "zero"})) == [(1, "one", "1")]
    soft, sig = one(spark, [([1000.0, 1000.0],)], "v array<float>", vectors.softmax(v), vectors.sigmoid(v))[0]
    assert soft == [0.5, 0.5] and sig == [1.0, 1.0]
    matrix = vectors.to_matrix(v, 2)
    got = one(spark, [([1.0, 2.0, 3.0, 4.0],)], "v array<float>", vectors.mean_pool(matrix), vectors.flatten(matrix))
    assert got == [([2.0, 3.0], [1.0, 2.0, 3.0, 4.0])]
