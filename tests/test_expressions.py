import uuid

from pyspark.sql import functions as F

from sentinelweave.functions import dates, identity, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_norm_text_and_tokens(spark):
    assert one(spark, text.norm_text(F.lit("  Straße  \n X "))) == "strasse x"
    assert one(spark, text.norm_text(F.lit("   "))) is None
    assert one(spark, text.tokens(F.lit("No se notificaron 3 casos de la Ñ"), True)) == ["no", "notificaron", "casos"]


def test_whole_term_is_literal_and_unicode_aware(spark):
    assert one(spark, text.whole_term(F.lit("Río (Negro)"), F.lit("en  río (negro), ayer")))
    assert not one(spark, text.whole_term(F.lit("R"), F.lit("Río")))
    assert one(spark, text.whole_term(F.lit("a\\Eb"), F.lit("x a\\Eb y")))


def test_clauses_split_only_at_strong_boundaries(spark):
    assert one(spark, text.clauses(F.lit("Se confirmaron 8, 2 probables y 3 sospechosos; no hay más: fin."))) == [
        "Se confirmaron 8", "2 probables", "3 sospechosos", "no hay más", "fin",
    ]
    assert one(spark, text.clauses(F.lit("A nivel nacional, no se notificó y otro a Chubut"))) == ["A nivel nacional, no se notificó y otro a Chubut"]


def test_anchors_unify_spellings(spark):
    assert one(spark, text.anchors(F.lit("El crucero M/V Hondius, y el buque Aurora Austral."))) == ["vessel:aurora austral", "vessel:mv hondius"]


def test_paragraph_spans(spark):
    source = "  uno \r\n \r\ndos\n\n\n\n tres"
    spans = one(spark, text.paragraphs(F.lit(source)))
    assert [p["text"] for p in spans] == ["uno", "dos", "tres"]
    assert all(source[p["start"]:p["end"]] == p["text"] for p in spans)
    assert [p["id"] for p in spans] == ["P001", "P002", "P003"]


def test_partial_dates_invent_nothing(spark):
    null, none = F.lit(None).cast("string"), F.lit(None).cast("int")

    def norm(value):
        p = one(spark, dates.partial_date(F.lit(value).cast("string"), none, none, F.lit("unknown"), null))
        return p["date"], p["year"], p["month"], p["precision"], p["verbatim"]

    assert norm("2004") == (None, 2004, None, "year", "2004")
    assert norm("2004-02") == (None, 2004, 2, "month", "2004-02")
    assert norm("2004-02-29") == ("2004-02-29", 2004, 2, "day", None)
    assert norm("2004-02-30") == (None, None, None, "unknown", "2004-02-30")
    assert norm(None) == (None, None, None, "unknown", None)


def test_uuid5_equals_the_standard_library(spark):
    for name in ("a", "events:event:v0.4.9:1:2", "ñandú"):
        assert one(spark, identity.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_entity_rules(spark):
    assert one(spark, identity.normalize_entity(F.lit(" Cepa Andes "), "pathogen"))["canonical_name"] == "Andes virus"
    assert one(spark, identity.normalize_entity(F.lit("landes"), "pathogen"))["normalization_status"] == "unresolved"
    assert one(spark, identity.normalize_entity(F.lit("Hantavirus"), "disease"))["confidence"] == 0.82
