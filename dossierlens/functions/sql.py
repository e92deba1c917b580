"""The scalar rules as temporary SQL functions, made from the same column builders that the DataFrame jobs use.

``sql_text`` writes a column expression as SQL. A rule is therefore stated once: its builder is called with columns named like
the function's parameters, and the text of the result is the body of the function. The optimizer inlines such bodies, so a
query through ``spark.sql`` gets the same plan as the DataFrame; no Python runs.
"""

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, SparkSession, functions as F

from dossierlens.functions import amounts, dates, identifiers, text as tx

INFIX = {"=": "=", "<=>": "<=>", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "and": "AND",
         "or": "OR", "&": "&", "|": "|", "^": "^", "div": "DIV"}
SUFFIXES = {"double": "D", "float": "F", "bigint": "L", "smallint": "S", "tinyint": "Y"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(node) -> str:
    value, kind = node.value(), node.dataType()
    kind = kind.get().catalogString() if kind.isDefined() else None
    if value is None:
        return "NULL" if kind in (None, "void") else f"CAST(NULL AS {kind})"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, float):
        return f"CAST({_quoted(repr(value))} AS DOUBLE)"
    if isinstance(value, int):
        return f"{value}{SUFFIXES.get(kind, '')}"
    name = value.getClass().getSimpleName()
    if name in ("Date", "LocalDate"):
        return f"DATE {_quoted(value.toString())}"
    if name in ("Timestamp", "Instant"):
        return f"TIMESTAMP {_quoted(value.toString())}"
    raise ValueError(f"no SQL for a literal of {name}")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _sql(node) -> str:
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return _literal(node)
    if kind == "UnresolvedAttribute":
        return ".".join(f"`{part}`" for part in _items(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return node.name()
    if kind == "LambdaFunction":
        return f"({', '.join(v.name() for v in _items(node.arguments()))}) -> {_sql(node.function())}"
    if kind == "Alias":
        return f"{_sql(node.child())} AS `{node.name().apply(0)}`"
    if kind == "Cast":
        return f"{'TRY_CAST' if node.sql().startswith('TRY_CAST') else 'CAST'}({_sql(node.child())} AS {node.dataType().sql()})"
    if kind == "UnresolvedExtractValue":
        return f"{_sql(node.child())}[{_sql(node.extraction())}]"
    if kind == "CaseWhenOtherwise":
        ways = "".join(f" WHEN {_sql(way._1())} THEN {_sql(way._2())}" for way in _items(node.branches()))
        other = f" ELSE {_sql(node.otherwise().get())}" if node.otherwise().isDefined() else ""
        return f"CASE{ways}{other} END"
    if kind == "UnresolvedFunction":
        name, parts = node.functionName(), [_sql(part) for part in _items(node.arguments())]
        if name in INFIX and len(parts) == 2:
            return f"({parts[0]} {INFIX[name]} {parts[1]})"
        if name in ("!", "not"):
            return f"(NOT {parts[0]})"
        if name == "in":
            return f"({parts[0]} IN ({', '.join(parts[1:])}))"
        return f"{name}({', '.join(parts)})"
    raise ValueError(f"no SQL for {kind}")


def sql_text(column: Column) -> str:
    """A column expression as SQL text that parses to the same expression."""
    return _sql(column._jc.node())


# Name -> parameters with types, and the builder. Builders get the parameters as columns, and the reference time.
FUNCTIONS: dict[str, tuple[str, Callable]] = {
    "siret_luhn": ("siret STRING", lambda as_of, siret: identifiers.siret_luhn(siret)),
    "siret_format": ("siret STRING", lambda as_of, siret: identifiers.siret_format(siret)),
    "iban_format": ("iban STRING", lambda as_of, iban: identifiers.iban_format(iban)),
    "tva_number": ("tva STRING, siren STRING", lambda as_of, tva, siren: identifiers.tva_number(tva, siren)),
    "tva_coherence": ("ht DOUBLE, tva DOUBLE, ttc DOUBLE, rate DOUBLE",
                      lambda as_of, ht, tva, ttc, rate: amounts.tva_coherence(ht, tva, ttc, rate)),
    "expiration_status": ("expiry STRING, doc_type STRING", lambda as_of, expiry, doc_type: dates.expiration_status(expiry, doc_type, as_of)),
    "kbis_age_status": ("issued STRING", lambda as_of, issued: dates.kbis_age_status(issued, as_of)),
    "siren_to_tva": ("siren STRING", lambda as_of, siren: identifiers.siren_to_tva(siren)),
    "iban_check_digits": ("bban STRING", lambda as_of, bban: identifiers.iban_check_digits(bban)),
    "bic_valid": ("bic STRING", lambda as_of, bic: identifiers.bic_valid(bic)),
    "clean_number": ("raw STRING", lambda as_of, raw: identifiers.clean_number(raw)),
    "parse_amount": ("raw STRING", lambda as_of, raw: amounts.parse_amount(raw)),
    "parse_date": ("raw STRING", lambda as_of, raw: dates.parse_date(raw)),
    "parse_iso": ("raw STRING", lambda as_of, raw: dates.parse_iso(raw)),
    "fix_numeric_ocr": ("raw STRING", lambda as_of, raw: tx.fix_numeric_ocr(raw)),
    "rate_plausible": ("ht DOUBLE, tva DOUBLE", lambda as_of, ht, tva: amounts.rate_plausible(ht, tva)),
    "snap_rate": ("rate DOUBLE, tolerance DOUBLE", lambda as_of, rate, tolerance: amounts.snap_rate(rate, tolerance, keep_unmatched=True)),
    "urgency": ("days_left INT", lambda as_of, days_left: dates.urgency(days_left)),
    "expiry_bucket": ("days_left INT", lambda as_of, days_left: dates.expiry_bucket(days_left)),
}


def register(spark: SparkSession, as_of: datetime = None) -> None:
    """Create the temporary functions. Rules that depend on the time judge as of ``as_of`` (by default: now, once)."""
    as_of = as_of or datetime.now()
    for name, (parameters, build) in FUNCTIONS.items():
        named = [F.col(p.split()[0]) for p in parameters.split(", ")]
        built = build(as_of, *named)
        empty = spark.createDataFrame([], parameters)
        returns = empty.select(built.alias("r")).schema["r"].dataType.simpleString()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {sql_text(built)}")
