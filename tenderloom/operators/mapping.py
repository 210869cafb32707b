"""Raw notices to typed rows, or the first reason why not.

Absent, null and blank are told apart, and the checks are ordered: the outcome of a notice is the
first check it fails. Everything is one projection over a payload parsed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.canonical import change_token
from tenderloom.functions.rows import computed_once
from tenderloom.functions.text import is_blank, quoted_payload, trimmed
from tenderloom.functions.times import instant_text, trimmed_instant
from tenderloom.functions.values import plain_text
from tenderloom.schemas import MONEY, NOTICES
from tenderloom import vocabulary as V

# The notice fields that are read, by the name used for them here.
FIELDS = {
    "opens": "dataAberturaProposta",
    "closes": "dataEncerramentoProposta",
    "control": "numeroControlePNCP",
    "object": "objetoCompra",
    "unit": "unidadeOrgao",
    "uf": "unidadeOrgao.ufSigla",
    "value": "valorTotalEstimado",
    "modality": "modalidadeId",
    "modality_name": "modalidadeNome",
    "published": "dataPublicacaoPncp",
    "updated": "dataAtualizacaoGlobal",
}
_ERROR = "struct<field:string,reason:string>"


def _v(name: str) -> Column:
    return F.col(f"_{name}")


def _t(name: str) -> Column:
    return F.col(f"_{name}_text")


def _text_of(text: Column, variant: Column) -> Column:
    """Text of a scalar; objects and arrays have none, which reads as blank."""
    opens = text.startswith("[") | text.startswith("{")
    nested = opens & F.schema_of_variant(variant).rlike("^(OBJECT|ARRAY)<")
    return F.when(F.coalesce(nested, F.lit(False)), F.lit("")).otherwise(text)


def _missing(name: str) -> Column:
    return _v(name).isNull() | F.is_variant_null(_v(name))


def _error(field: str | Column, reason: str | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(field).alias("field"), as_column(reason).alias("reason"))


def _text_error(name: str, field: str) -> Column:
    return (
        F.when(_v(name).isNull(), _error(field, V.FIELD_ABSENT))
        .when(F.is_variant_null(_v(name)), _error(field, V.FIELD_NULL))
        .when(is_blank(_t(name)), _error(field, V.FIELD_BLANK))
        .when(_t(name).contains("�"), _error(field, V.FIELD_MISDECODED))
    )


def _instant_error(name: str, field: str) -> Column:
    """Present and not blank, yet unreadable."""
    return F.when(
        _t(name).isNotNull() & ~is_blank(_t(name)) & F.col(f"_{name}_at").isNull(),
        _error(field, F.concat(F.lit(V.NOT_A_TIMESTAMP), _t(name))),
    )


def biddability(opens: Column, closes: Column) -> Column:
    """Whether a notice has a proposal window at all; never looks at the clock."""
    return (
        F.when(opens.isNull() & closes.isNull(), _kind(V.NOT_BIDDABLE, F.lit(V.NO_WINDOW)))
        .when(closes.isNull(), _kind("malformed", F.lit(V.NO_CLOSING)))
        .when(opens.isNull(), _kind("malformed", F.lit(V.NO_OPENING)))
        .when(
            closes < opens,
            _kind(
                "malformed",
                F.format_string(V.CLOSES_FIRST, instant_text(opens), instant_text(closes)),
            ),
        )
        .otherwise(_kind("biddable", F.lit(None).cast("string")))
    )


def _kind(kind: str, reason: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), reason.alias("reason"))


def _modality_errors() -> tuple[Column, Column]:
    field = FIELDS["modality"]
    number = F.schema_of_variant(_v("modality")).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    wide = F.try_variant_get(_v("modality"), "$", "double")
    in_range = wide.between(-(2.0**31), 2.0**31 - 1)
    shape = (
        F.when(_v("modality").isNull(), _error(field, V.FIELD_ABSENT))
        .when(F.is_variant_null(_v("modality")), _error(field, V.FIELD_NULL))
        .when(
            ~F.coalesce(number & in_range, F.lit(False)),
            _error(field, F.concat(F.lit(V.NOT_WHOLE), _t("modality"))),
        )
    )
    invariant = F.when(
        F.col("_modality_code") <= 0,
        _error(
            "notice", F.concat(F.lit(V.MODALITY_NOT_POSITIVE), F.col("_modality_code").cast("string"))
        ),
    )
    return shape, invariant


def _value_error() -> Column:
    field = FIELDS["value"]
    kind = F.schema_of_variant(_v("value"))
    wide = F.try_variant_get(_v("value"), "$", "double")
    return (
        F.when(_missing("value"), F.lit(None).cast(_ERROR))
        .when(
            ~kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"),
            _error(field, F.concat(F.lit(V.NOT_A_NUMBER), _t("value"))),
        )
        .when(wide < 0, _error(field, F.concat(F.lit(V.NEGATIVE_VALUE), _t("value"))))
    )


def _amount() -> Column:
    """The amount as it was written, without exponent or needless zeros."""
    text = _t("value")
    whole = F.try_variant_get(_v("value"), "$", MONEY.simpleString())
    double = text.rlike("[eE]")
    same = whole.cast("double") == F.try_variant_get(_v("value"), "$", "double")
    return F.when(~double, plain_text(text)).when(same, plain_text(whole.cast("string"))).otherwise(text)


def _range_value(amount: Column) -> Column:
    """The amount cut after ten decimals, or the greatest value there is, for range tests."""
    parts = F.regexp_extract(amount, r"^(\d+)(?:\.(\d{1,10}))?", 0)
    most = F.lit("9" * (MONEY.precision - MONEY.scale) + "." + "9" * MONEY.scale)
    cut = F.when(amount.rlike("[eE]"), F.col("_wide").cast("string")).otherwise(parts)
    value = cut.try_cast(MONEY)
    return F.when(amount.isNotNull(), F.coalesce(value, most.cast(MONEY)))


def map_notices(notices: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``outcome`` with the typed columns, or with ``field`` and ``reason``.

    The typed columns are filled only for mapped notices. Keep the result (``persist``) when it
    feeds more than one of the three splits below.
    """
    kept = [F.col(c) for c in notices.columns]
    parsed = notices.withColumn("_notice", F.expr(f"try_parse_json({payload})"))
    extracted = parsed.select(
        *kept,
        F.col("_notice").isNull().alias("_unreadable"),
        *[
            F.variant_get("_notice", f"$.{path}", "variant").alias(f"_{name}")
            for name, path in FIELDS.items()
        ],
    )
    # What is read several times becomes a column first, or it would be worked out each time.
    read = [name for name in FIELDS if name != "unit"]
    instants = ("opens", "closes", "published", "updated")
    texts = extracted.withColumns({f"_{name}_cast": _v(name).cast("string") for name in read})
    texts = texts.withColumns({f"_{name}_text": _text_of(F.col(f"_{name}_cast"), _v(name)) for name in read})
    texts = texts.withColumns({f"_{name}_body": trimmed(_t(name)) for name in instants})
    typed = texts.withColumns(
        {
            **{f"_{name}_at": trimmed_instant(F.col(f"_{name}_body")) for name in instants},
            "_wide": F.try_variant_get("_value", "$", "double"),
            "_amount": F.when(~_missing("value"), _amount()),
            "_modality_code": F.try_variant_get("_modality", "$", "int"),
            "_uf_code": F.upper(trimmed(_t("uf"))),
        }
    ).withColumn("_window", biddability(F.col("_opens_at"), F.col("_closes_at")))

    modality_shape, modality_invariant = _modality_errors()
    before_window = F.coalesce(
        _instant_error("opens", FIELDS["opens"]), _instant_error("closes", FIELDS["closes"])
    )
    window = F.when(
        F.col("_window.kind") == "malformed", _error("proposalWindow", F.col("_window.reason"))
    )
    state = (
        F.when(_missing("unit"), _error(FIELDS["unit"], V.UNIT_MISSING))
        .when(_text_error("uf", "ufSigla").isNotNull(), _text_error("uf", "ufSigla"))
        .when(
            ~F.col("_uf_code").isin(V.STATES),
            _error(FIELDS["uf"], F.concat(F.lit(V.NOT_A_STATE), _t("uf"))),
        )
    )
    after_window = F.coalesce(
        _text_error("control", FIELDS["control"]),
        _text_error("object", FIELDS["object"]),
        state,
        _value_error(),
        modality_shape,
        _text_error("modality_name", FIELDS["modality_name"]),
        modality_invariant,
        _text_error("published", FIELDS["published"]),
        _instant_error("published", FIELDS["published"]),
        _instant_error("updated", FIELDS["updated"]),
    )
    error = F.when(
        F.col("_unreadable"), _error("notice", F.lit("the payload is not JSON"))
    ).otherwise(
        F.coalesce(
            before_window,
            window,
            F.when(F.col("_window.kind") == "biddable", after_window),
        )
    )
    outcome = (
        F.when(F.col("_error").isNotNull(), V.REJECTED)
        .when(F.col("_window.kind") == V.NOT_BIDDABLE, V.NOT_BIDDABLE)
        .otherwise(V.MAPPED)
    )
    # The verdict alone is kept from being repeated, so that what reads only that makes no typed column.
    checked = computed_once(
        typed.withColumn("_error", error), {"_fault": F.col("_error"), "outcome": outcome}, keep=typed.columns
    )
    mapped = F.col("outcome") == V.MAPPED
    columns = {
        "object_description": _t("object"),
        "state": F.col("_uf_code"),
        "estimated_value": _range_value(F.col("_amount")),
        "estimated_amount": F.col("_amount"),
        "modality_code": F.col("_modality_code"),
        "modality_name": _t("modality_name"),
        "published_at": F.col("_published_at"),
        "proposal_opens_at": F.col("_opens_at"),
        "proposal_closes_at": F.col("_closes_at"),
        "source_updated_at": F.col("_updated_at"),
    }
    untouched = [c for c in notices.columns if c not in columns and c != "control_number"]
    result = {
        "outcome": F.col("outcome"),
        "control_number": F.coalesce(_t("control"), F.lit(V.UNKNOWN_NOTICE)),
        **{name: F.when(mapped, expression) for name, expression in columns.items()},
        "field": F.col("_fault.field"),
        "reason": F.coalesce(
            F.col("_fault.reason"),
            F.when(F.col("outcome") == V.NOT_BIDDABLE, F.col("_window.reason")),
        ),
    }
    return checked.select(*untouched, *[column.alias(name) for name, column in result.items()])


def with_change_token(notices: DataFrame, payload: str = "payload") -> DataFrame:
    """Add the content hash; the only step of mapping that leaves the JVM."""
    return notices.withColumn("source_payload_hash", change_token(F.col(payload)))


def mapped_notices(mapped: DataFrame, extra: list[str] = ()) -> DataFrame:
    """The notices that became rows, hashed, in the layout of the notices table."""
    rows = with_change_token(mapped.filter(F.col("outcome") == V.MAPPED))
    return rows.select(*extra, *NOTICES.fieldNames())


def not_biddable(mapped: DataFrame) -> DataFrame:
    return mapped.filter(F.col("outcome") == V.NOT_BIDDABLE).select("control_number", "reason")


def rejected(mapped: DataFrame) -> DataFrame:
    """Rejected notices; one that cannot be identified carries its quoted payload."""
    return mapped.filter(F.col("outcome") == V.REJECTED).select(
        "control_number",
        "field",
        "reason",
        F.when(
            F.col("control_number") == V.UNKNOWN_NOTICE,
            quoted_payload(F.col("payload"), V.QUOTE_LENGTH, V.EMPTY_BODY),
        ).alias("payload"),
    )


def changed(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Incoming rows that are new or whose content differs from the stored row."""
    stored = current.select("control_number", F.col("source_payload_hash").alias("_stored_hash"))
    return (
        incoming.join(stored, "control_number", "left")
        .filter(~F.col("source_payload_hash").eqNullSafe(F.col("_stored_hash")))
        .drop("_stored_hash")
    )


__all__ = [
    "biddability",
    "changed",
    "map_notices",
    "mapped_notices",
    "not_biddable",
    "rejected",
    "with_change_token",
]
