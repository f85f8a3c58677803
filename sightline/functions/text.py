"""Strings: plate normalisation, distance and error rate, outcomes, split names, licences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Outcomes of one plate, in the order in which stages can lose it.
CORRECT, MISSED, OCR_ERROR, REJECTED, CORRUPTED = "correct", "detection_miss", "ocr_error", "grammar_rejected", "grammar_corrupted"

# What stays of a reading, the strip that is no part of a plate, and how a district is set off.
NO_PLATE, STRIP, HINT = "[^A-Z0-9ÄÖÜ]", r"^IND(?=[A-Z]{2}\d)", r"^\s*([A-ZÄÖÜ]{1,3})\s*[-–—.\s]\s*(?=[A-Z])"


def normalize_plate(raw: Column) -> Column:
    """Upper-case letters (with AE, OE, UE umlauts) and digits of a reading, without a leading IND strip; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.upper(raw), NO_PLATE, ""), STRIP, "")


def district_hint(raw: Column) -> Column:
    """The one to three letters that a separator sets off at the start of a reading; null if none does."""
    hint = F.regexp_extract(F.upper(raw), HINT, 1)
    return F.nullif(hint, F.lit(""))


def error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over the reference's length; for an empty reference 0 if nothing was read, else 1."""
    return F.when(reference == "", F.when(hypothesis == "", 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, hypothesis) / F.length(reference))


def classify(truth: Column, raw: Column, final: Column) -> Column:
    """The stage that lost a plate, or ``correct``; a null ``final`` is a reading that no grammar took."""
    return F.when(final.isNull(), REJECTED).when(final == truth, CORRECT).when(raw == truth, CORRUPTED).otherwise(OCR_ERROR)


def split_side(split: Column) -> Column:
    """``train``, ``val`` or ``test`` for the spellings in use; null for anything else."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", "train").when(s.isin("val", "valid", "validation"), "val").when(s == "test", "test")


def redistributable(licence: Column) -> Column:
    """Whether a licence has neither a no-derivatives nor a non-commercial clause, as words of their own."""
    return ~F.upper(licence).rlike(r"\b(ND|NC)\b")


def first_result(results: Column) -> tuple[Column, Column]:
    """(text, confidence) of the first of a reader's results, given as JSON: ``rec_text`` and ``rec_score`` of a list's first entry.

    Whatever is missing or of another shape is an empty text, or a confidence of 0.
    """
    text = F.get_json_object(results, "$[0].rec_text")
    score = F.get_json_object(results, "$[0].rec_score").try_cast("double")
    return F.coalesce(text, F.lit("")), F.coalesce(score, F.lit(0.0))
