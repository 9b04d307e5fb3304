"""Text, routing and configuration expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that trimming removes, as a class for regular expressions.
BLANK = "\\s\\p{Z}\\x{FEFF}"
#: Model files by kind.
URLS_JA = {
    "layout": "deim-s-1024x1024.onnx",
    "recognition30": "parseq-ndl-30.onnx",
    "recognition50": "parseq-ndl-50.onnx",
    "recognition100": "parseq-ndl-100.onnx",
}
URLS_EUROPEAN = {"layout": "deim-s-1024x1024.onnx", "recognitionEuropean": "parseq-multilingual.onnx"}
URLS_MATH = {"mathEncoder": "mfr-encoder.onnx", "mathDecoder": "mfr-decoder.onnx"}
MODEL_BASE = "/models/ocr"
#: Languages a document can be set to.
DOCUMENT_LANGUAGES = ("ja", "en", "de", "fr", "es", "pt", "it", "nl", "cs", "pl", "da", "no", "fi")


def unicode_trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{BLANK}]+|[{BLANK}]+$", "")


def characters(s: Column) -> Column:
    return F.split(s, "")


def recognition_language(doc_lang: Column) -> Column:
    return F.when(doc_lang == "ja", "ja").otherwise("european")


def recogniser(char_count: Column, language: Column | None = None, layout_only: Column | None = None) -> Column:
    """Model by predicted length class: 3 short, 2 medium, any other long; one model for European texts."""
    by_length = F.when(char_count == 3, "recognition30").when(char_count == 2, "recognition50").otherwise("recognition100")
    out = by_length if layout_only is None else F.when(layout_only, "recognition100").otherwise(by_length)
    return out if language is None else F.when(language == "european", "recognitionEuropean").otherwise(out)


def cache_key(language: Column, model: Column) -> Column:
    return F.when(language.isNotNull() & (language != "ja"), F.concat_ws(":", language, model)).otherwise(model)


def _url_map(*parts: dict[str, str]) -> Column:
    held = {k: f"{MODEL_BASE}/{v}" for p in parts for k, v in p.items()}
    return F.create_map(*[F.lit(x) for pair in held.items() for x in pair])


def model_url(model: Column, language: Column, math: Column | None = None, strict: bool = False) -> Column:
    """URL of a model; unknown kinds are null, or an error if strict."""
    math = F.lit(False) if math is None else math
    pick = lambda base: F.when(math, F.try_element_at(_url_map(base, URLS_MATH), model)).otherwise(F.try_element_at(_url_map(base), model))
    url = F.when(language == "european", pick(URLS_EUROPEAN)).otherwise(pick(URLS_JA))
    return F.coalesce(url, F.raise_error(F.concat(F.lit("unknown model: "), model))) if strict else url


def is_html(content_type: Column) -> Column:
    return F.lower(content_type).contains("text/html")


def content_length(header: Column) -> Column:
    return F.coalesce(header.try_cast("int"), F.lit(0))


def data_url(payload: Column, mime: str = "image/jpeg") -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(payload))


def data_url_payload(url: Column) -> Column:
    """Bytes of a base64 data URL; null for another scheme."""
    return F.when(url.startswith("data:"), F.unbase64(F.element_at(F.split(url, ",", 2), 2)))


def model_config(stored: Column) -> Column:
    """mathEnabled of a stored JSON preference; anything unreadable is false."""
    return F.coalesce(F.from_json(stored, "mathEnabled boolean")["mathEnabled"], F.lit(False))


def document_language(stored: Column) -> Column:
    return F.when(stored.isin(*DOCUMENT_LANGUAGES), stored).otherwise("ja")
