"""Edge values of the column functions."""

from pyspark.sql import functions as F

from nearwell.functions import cleaning as C
from nearwell.functions import geo as G
from nearwell.functions import messages as M
from nearwell.functions import presentation as P
from nearwell.functions import similarity as S
from nearwell.functions import vectors as V


def values(spark, schema, rows, *cols):
    out = spark.createDataFrame(rows, schema).select(*[c.alias(f"c{i}")
                                                       for i, c in enumerate(cols)]).collect()
    return [tuple(r) if len(cols) > 1 else r[0] for r in out]


def test_types_and_pins(spark):
    rows = [(None,), ("",), (" NULL ",), ("Farmacy",), (" Clinic",), ("prose, text",)]
    assert values(spark, "t string", rows, C.normalize_type(F.col("t"))) == [
        None, None, None, "pharmacy", "clinic", "prose, text"]
    assert values(spark, "t string", rows, C.has_known_type(F.col("t"))) == [
        True, True, True, True, True, False]
    pins = [("12 34\t56",), ("1234567",), ("12345a",), (None,), ("000001",)]
    assert values(spark, "p string", pins, C.normalize_pin(F.col("p"))) == [
        "123456", None, None, None, "000001"]


def test_json_lists_survive_bad_text(spark):
    rows = [("[oops",), ("[]",), ('["a",null,3]',), (None,)]
    assert values(spark, "j string", rows, C.json_strings(F.col("j"))) == [
        None, [], ["a", None, "3"], None]


def test_trigrams_follow_postgres(spark):
    rows = [("word", "two words"), (None, "x"), ("", "!"), ("ABC", "abc"), ("é", "E")]
    out = values(spark, "a string, b string", rows, S.trigram_similarity(F.col("a"), F.col("b")))
    assert [None if x is None else round(x, 6) for x in out] == [0.363636, None, 0.0, 1.0, 0.0]


def test_threshold_compares_as_single_precision(spark):
    # 3 shared grams of 25 is 0.12 as a float, which is not above 0.12
    out = values(spark, "a array<int>, b array<int>", [(list(range(14)), list(range(11, 25)))],
                 S.gram_similarity(F.col("a"), F.col("b")))
    assert out[0] < 0.12 and round(out[0], 6) == 0.12


def test_gram_codes_are_one_to_one(spark):
    rows = [("Éa दिल abc",), ("",), (None,)]
    for grams, codes in values(spark, "t string", rows, S.trigrams(F.col("t")),
                               S.gram_codes(F.col("t"))):
        back = None if codes is None else [
            "".join(chr((c >> s) & 0x1FFFFF) for s in (42, 21, 0)) for c in codes]
        assert back == grams


def test_pins_in_messages(spark):
    rows = [("near 800001",), ("1234567 and 123456.",), ("800001 or 110001",), ("x123456",), (None,)]
    assert values(spark, "t string", rows, M.extract_pin(F.col("t"))) == [
        "800001", "123456", "800001", None, None]


def test_need_near_place(spark):
    rows = [("Eye near clinic NEAR Gaya ",), ("near Patna",), ("x near ",), ("a\nb near c",)]
    assert values(spark, "t string", rows, M.need_part(F.col("t")), M.place_part(F.col("t"))) == [
        ("Eye", "clinic NEAR Gaya"), (None, None), (None, None), (None, None)]


def test_emergencies(spark):
    rows = [("chest pain",), ("I cant breathe",), ("can't breathe!",), ("strokes",), ("_stroke",),
            ("snakebite",), ("उन्हें दिल का दौरा",), ("BEHOSH hai",), ("दिलstroke",), ("eye care",)]
    assert values(spark, "t string", rows, M.emergency_flag(F.col("t"))) == [
        True, True, True, False, False, True, True, True, True, False]


def test_json_replies(spark):
    rows = [('```json\n{"need":"x"}\n```',), ('{"need":',), ("none",), (None,), ('{"a":1} {"b":2}',)]
    out = values(spark, "t string", rows, M.extract_json_object(F.col("t"), "need string"))
    assert [None if o is None else o.need for o in out] == ["x", None, None, None, None]


def test_suspect_evidence_is_three_valued(spark):
    rows = [("City Dental", "Bypass surgery"), ("City", "bypass"), (None, "bypass"),
            ("Eye", "cataract")]
    assert values(spark, "n string, t string", rows,
                  M.suspect_evidence(F.col("n"), F.col("t"))) == [True, False, None, False]


def test_distances(spark):
    rows = [(10.0, 75.0, 10.0, 75.0), (0.0, 0.0, 0.0, 180.0), (None, 1.0, 1.0, 1.0)]
    args = [F.col(c) for c in "abcd"]
    out = values(spark, "a double, b double, c double, d double", rows, G.distance_slc(*args),
                 G.distance_haversine(*args))
    assert out[0][1] == 0.0 and out[0][0] < 1e-3
    assert round(out[1][0]) == round(out[1][1]) == 20015
    assert out[2] == (None, None)


def test_cosine_and_score(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])]
    out = values(spark, "a array<float>, b array<float>", rows,
                 F.round(V.cosine_similarity(F.col("a"), F.col("b")), 6))
    assert out == [0.707107, None]
    score = values(spark, "s double, beds int, d int", [(0.5, 400, None), (0.5, None, 15)],
                   V.hybrid_score(F.col("s"), F.lit(10.0), F.lit(50.0), F.col("beds"), F.col("d")))
    assert score == [0.6, 0.525]


def test_vector_text(spark):
    out = values(spark, "s string", [("[1.5,-2]",), (" [0.25, 3]",)],
                 V.parse_vector(F.col("s")))
    assert out == [[1.5, -2.0], [0.25, 3.0]]


def test_presentation(spark):
    rows = [(28.0, 77.25, "A & B (x)", "Gaya"), (None, 77.0, "A+B", None)]
    args = [F.col(c) for c in ("lat", "lng", "n", "c")]
    urls = values(spark, "lat double, lng double, n string, c string", rows,
                  P.directions_url(*args))
    assert urls[0].endswith("destination=28,77.25") and urls[1].endswith("query=A%2BB%2C%20")
    labels = values(spark, "s double", [(0.549,), (0.55,), (None,)], P.match_label(F.col("s")))
    assert labels == ["55% related", "55% match", "0% related"]
    assert values(spark, "l string", [("hi",), ("fr",)], P.speech_locale(F.col("l"))) == [
        "hi-IN", "fr-IN"]
    users = values(spark, "e string", [(None,), ("local-dev",), ("a@b",)],
                   P.pseudonymize_user(F.col("e"), "s"))
    assert users[0] == users[1] != users[2] and len(users[2]) == 34


def test_unescape_html(spark):
    from html import unescape

    from nearwell.functions.cleaning import unescape_html
    texts = ["", "plain & simple; &", "a&amp;#39;b &#39;&#x27; &lt;b&gt; &eacute;&nbsp;&hearts;&unknown;",
             "&#128512;&#x1F600; &amp;amp;", "&amp", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", unescape_html(df.t)).collect()}
    assert got == {i: None if t is None else (t if t == "&amp" else unescape(t))
                   for i, t in enumerate(texts)}
