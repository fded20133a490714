"""Personal-data redaction in its two orders, and span redaction."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentspark.functions import patterns as P
from talentspark.functions.text import let, text_sanitize

PHONE_DATASET = "|".join([P.PHONE_INTERNATIONAL, P.PHONE_THREE_THREE_FOUR, P.PHONE_FIVE_THREE])
PHONE_SERVING = PHONE_DATASET + "|" + P.PHONE_BETWEEN_SLASHES


def _begun(first: str, pattern: str) -> str:
    """The pattern, tried only where one of the characters ``first`` stands, with which each of its finds begins."""
    return f"(?=[{first}])(?:{pattern})"


# order matters: an early rule can swallow text a later one would have found
SERVING_RULES = [
    (P.ADDRESS, "[ADDRESS]"),
    (_begun("+(/0-9", PHONE_SERVING), "[PHONE]"),
    (_begun("0-9", P.ZIP), "[ZIP]"),
    (P.POBOX, "[POBOX]"),
    (P.EMAIL, "[EMAIL]"),
]
DATASET_RULES = [
    (P.EMAIL, "[EMAIL]"),
    (_begun("+(0-9", PHONE_DATASET), "[PHONE]"),
    (P.POBOX, "[ADDRESS]"),
    (P.ADDRESS, "[ADDRESS]"),
    (_begun("0-9", P.ZIP), "[ZIP]"),
]


def _apply(text: Column, rules) -> Column:
    for pattern, label in rules:
        text = F.regexp_replace(text, pattern, label)
    return text


def redact_serving(c: Column) -> Column:
    """Sanitise, then ADDRESS, PHONE, ZIP, POBOX, EMAIL."""
    return _apply(text_sanitize(c), SERVING_RULES)


def redact_dataset(c: Column) -> Column:
    """Sanitise, then EMAIL, PHONE, post box (as ADDRESS), ADDRESS, ZIP."""
    return _apply(text_sanitize(c), DATASET_RULES)


def wanted_labels(labels: list[str] | None, known: list[str] | None) -> list[str]:
    """The labels to redact; raises on one that the entity finder, which gives the ``known`` ones, never finds."""
    labels = P.PII_LABELS if labels is None else labels
    unknown = [] if known is None else [label for label in labels if label not in known]
    if unknown:
        raise ValueError(f"unknown entity labels: {unknown}")
    return labels


def redact_spans(text: Column, spans: Column, labels: list[str] | None = None, known: list[str] | None = None) -> Column:
    """Replace the spans (array of struct<label,start,end,...>) of the given labels by
    ``[LABEL]``. Offsets refer to the given text; spans do not overlap. ``known``: see ``wanted_labels``.

    The result joins the stretches between the spans, which copies the text once, however many
    spans it has.
    """
    wanted = F.filter(spans, lambda s: s["label"].isin(wanted_labels(labels, known)))
    ordered = F.array_sort(
        F.transform(wanted, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["label"].alias("l")))
    )

    def rebuild(spans: Column) -> Column:
        resume = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["b"]))
        pieces = F.zip_with(
            spans, F.slice(resume, F.lit(1), F.size(spans)),
            lambda s, at: F.concat(F.substring(text, at + 1, s["a"] - at), F.lit("["), s["l"], F.lit("]")),
        )
        tail = F.substring(text, F.element_at(resume, -1) + 1, F.length(text))
        return F.concat(F.array_join(pieces, ""), tail)

    return F.coalesce(let(ordered, rebuild), text)
