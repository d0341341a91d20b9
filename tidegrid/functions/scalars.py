"""Column expressions shared by the operators; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.times import as_col

# Tolerances of the closeness test.
RELATIVE_TOLERANCE = 1e-9
ABSOLUTE_TOLERANCE = 1e-12

# Query parameters whose value is a credential (compared in
# lower case with "_" and "-" removed).
SENSITIVE_PARAMETERS = (
    "accesskey", "accesstoken", "apikey", "authorization", "clientsecret", "credential", "key",
    "passwd", "password", "secret", "securitytoken", "signature", "token",
)

# Words of free text whose value is a credential (compared in the same way).
SENSITIVE_WORDS = ("password", "secret", "token", "apikey", "accesskey", "authorization")

# Left-closed price regimes.
REGIMES = ("Negative", "Normal", "High", "Extreme")
REGIME_EDGES = (0.0, 100.0, 200.0)


def number(column: Column | str) -> Column:
    """Lenient number: text that does not parse, and NaN, become null."""
    value = as_col(column).try_cast("double")
    return F.when(~F.isnan(value), value)


def is_finite(column: Column | str) -> Column:
    value = as_col(column)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def close(a: Column | str, b: Column | str, rel: float = RELATIVE_TOLERANCE,
          absolute: float = ABSOLUTE_TOLERANCE) -> Column:
    """|a - b| <= absolute + rel * |b|."""
    left, right = as_col(a), as_col(b)
    return F.abs(left - right) <= F.lit(absolute) + F.lit(rel) * F.abs(right)


def same_cell(a: Column, b: Column) -> Column:
    """Equal cells: numbers by closeness, everything else as text, null equals null."""
    left, right = a.try_cast("double"), b.try_cast("double")
    numeric = left.isNotNull() & right.isNotNull()
    return (
        F.when(a.isNull() & b.isNull(), True)
        .when(a.isNull() | b.isNull(), False)
        .when(numeric, close(left, right))
        .otherwise(a.cast("string") == b.cast("string"))
    )


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that is null for a zero denominator, in ANSI mode too."""
    return numerator / F.nullif(denominator, F.lit(0.0))


def price_regime(price: Column | str) -> Column:
    value = as_col(price)
    low, mid, high = REGIME_EDGES
    return (
        F.when(value < low, REGIMES[0])
        .when(value < mid, REGIMES[1])
        .when(value < high, REGIMES[2])
        .when(value.isNotNull(), REGIMES[3])
    )


def revision_rank(revision: Column | str) -> Column:
    """Revision text as a number for ordering; anything else ranks below zero."""
    return F.coalesce(number(revision), F.lit(-1.0))


def has_explicit_zone(text: Column | str) -> Column:
    return as_col(text).rlike("(Z|[+-][0-9]{2}:[0-9]{2})$")


def redact_query(url: Column | str) -> Column:
    """Replace the values of credential-like query parameters, keep the rest."""
    column = as_col(url)
    fragment = F.regexp_extract(column, "#.*$", 0)
    bare = F.regexp_replace(column, "#.*$", "")
    head = F.split(bare, "\\?", 2)[0]
    query = F.get(F.split(bare, "\\?", 2), F.lit(1))

    def clean(pair: Column) -> Column:
        name = F.split(pair, "=", 2)[0]
        # an encoded name is the same name; one that cannot be decoded is compared as it is
        plain = F.coalesce(F.try_url_decode(name), name)
        normal = F.regexp_replace(F.lower(plain), "[_-]", "")
        return F.when(
            normal.isin(*SENSITIVE_PARAMETERS), F.concat(name, F.lit("=[REDACTED]"))
        ).otherwise(pair)

    rebuilt = F.array_join(F.transform(F.split(query, "&"), clean), "&")
    return F.when(query.isNull(), column).otherwise(
        F.concat(head, F.lit("?"), rebuilt, fragment)
    )


def _without_userinfo(word: Column) -> Column:
    """A blank-free word; user and password before the host of a URL are masked."""
    scheme = F.substring_index(word, "://", 1)
    rest = F.substr(word, F.length(scheme) + 4)
    host = F.substring_index(rest, "@", -1)
    user = F.substr(rest, F.lit(1), F.length(rest) - F.length(host) - 1)
    return F.when(word.contains("://") & rest.contains("@") & user.contains(":") & ~F.substring_index(user, ":", 1).contains("/"),
                  F.concat(scheme, F.lit("://[REDACTED]@"), host)).otherwise(word)


def _names_secret(text: Column) -> Column:
    """Whether the text ends in a credential's name, marks and case aside."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "").rlike(f"({'|'.join(SENSITIVE_WORDS)})$")


def _may_hold_secret(text: Column) -> Column:
    """Whether a credential's name, marks and case aside, or the word bearer stands anywhere; without one, no piece is masked."""
    names = "|".join((*SENSITIVE_WORDS, "bearer"))
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "").rlike(names)


def redact_text(text: Column | str) -> Column:
    """Mask bearer tokens, the values of credential names and URL credentials in free text.

    The text is cut after blanks and ``& , ;``. A piece is masked by what it
    holds (a name, ``:`` or ``=``, a value) or by the two pieces before it (a
    name and its separator, or the word bearer).
    """
    words = F.split(as_col(text), r"(?<=\s)(?=\S)")
    pieces = F.split(F.array_join(F.transform(words, _without_userinfo), ""), r"(?<=[\s&,;])(?=[^\s&,;])")
    none = F.lit("")
    rows = F.arrays_zip(pieces.alias("piece"), F.concat(F.array(none), pieces).alias("last"),
                        F.concat(F.array(none, none), pieces).alias("older"))
    mask = F.lit("[REDACTED]")

    def word(piece: Column) -> Column:
        return F.regexp_extract(piece, r"^[^\s&,;]*", 0)

    def tail(piece: Column) -> Column:
        return F.substr(piece, F.length(word(piece)) + 1)

    def head(piece: Column) -> Column:
        """What stands before the first separator with a credential's name on its left; null without one."""
        parts = F.split(word(piece), "[:=]")
        at = F.array_position(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), _names_secret), True)
        size = F.aggregate(F.slice(parts, F.lit(1), at.cast("int")), F.lit(-1), lambda n, p: n + 1 + F.length(p))
        return F.when(at > 0, F.substr(word(piece), F.lit(1), size))

    def blank(piece: Column) -> Column:
        return F.trim(F.regexp_replace(tail(piece), r"\s", "")) == ""

    def bare(piece: Column) -> Column:
        return ~word(piece).rlike("[:=]") & _names_secret(word(piece)) & blank(piece)

    def waits(piece: Column, before: Column) -> Column:
        """Whether a value is still to come."""
        own = F.coalesce(F.length(head(piece)) + 1 == F.length(word(piece)), F.lit(False))
        return blank(piece) & (own | (word(piece).isin(":", "=") & bare(before)))

    def clean(row: Column) -> Column:
        piece, last, older = row["piece"], row["last"], row["older"]
        return F.when(_may_hold_secret(F.concat(older, last, piece)), masked(piece, last, older)).otherwise(piece)

    def masked(piece: Column, last: Column, older: Column) -> Column:
        given = F.concat(F.lit("="), F.when(waits(piece, last), none).otherwise(F.concat(mask, tail(piece))))
        return (
            F.when(word(piece) == "", piece)
            .when(waits(last, older) | ((F.lower(word(last)) == "bearer") & blank(last)), F.concat(mask, tail(piece)))
            .when(word(piece).rlike("^[:=]") & bare(last), given)
            .when(head(piece).isNotNull() & (F.length(head(piece)) + 1 == F.length(word(piece))) & ~blank(piece), piece)
            .when(head(piece).isNotNull(), F.concat(head(piece), given))
            .otherwise(piece)
        )

    # a text that holds nothing to mask stays as it is; it is not cut into pieces
    plain = ~(_may_hold_secret(as_col(text)) | (as_col(text).contains("://") & as_col(text).contains("@")))
    return F.when(plain, as_col(text)).when(as_col(text).isNotNull(), F.array_join(F.transform(rows, clean), ""))


def drop_sensitive_keys(entries: Column) -> Column:
    """Entries of a string map whose key, letters and digits in lower case, holds no credential's name."""
    names = "|".join((*SENSITIVE_WORDS, "credential"))
    return F.map_filter(entries, lambda key, _: ~F.regexp_replace(F.lower(key), "[^a-z0-9]", "").rlike(names))


def collapse_blanks(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(as_col(text), r"\s+", " "))


def concise(text: Column | str, length: int = 160) -> Column:
    """One line of at most ``length`` characters, ending in an ellipsis when cut."""
    line = collapse_blanks(redact_text(text))
    cut = F.concat(F.rtrim(F.substring(line, 1, length - 1)), F.lit("…"))
    return F.when(F.length(line) <= length, line).otherwise(cut)


def history_message(message: Column | str, length: int = 160) -> Column:
    """A line for a history list: the text of a message, or what its JSON object says.

    Of an object that is its message, else the number of missing times and the
    first unresolved one, else a fixed line; an empty message says so.
    """
    text = as_col(message)
    holds = F.coalesce(F.try_parse_json(text), F.parse_json(F.lit("null")))
    part = lambda name: F.try_variant_get(holds, f"$.{name}", "string")
    said = F.nullif(part("message"), F.lit(""))
    has_first = F.coalesce(F.array_contains(F.json_object_keys(text), "first_unresolved_timestamp"), F.lit(False))
    parts = F.concat_ws("; ", F.concat(part("missing_count"), F.lit(" missing timestamps")),
                        F.concat(F.lit("first unresolved "), F.nullif(part("first_unresolved_timestamp"), F.lit(""))))
    gap = F.when(has_first, F.coalesce(F.nullif(parts, F.lit("")), F.lit("Source continuity warning recorded.")))
    is_object = F.json_object_keys(text).isNotNull()
    line = F.when(is_object, F.coalesce(said, gap, F.lit("Operational metadata recorded."))).otherwise(
        F.coalesce(F.nullif(text, F.lit("")), F.lit("No message recorded.")))
    return concise(line, length)


def slug(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(as_col(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def allow_code(value: Column | str, allowed: list[str], default: str | None = None) -> Column:
    column = as_col(value)
    return F.when(column.isin(*allowed), column).otherwise(F.lit(default).cast("string"))


def run_status_label(status: Column | str) -> Column:
    """Display text of a run status."""
    normal = F.upper(F.trim(as_col(status)))
    return (
        F.when(normal == "SUCCESS", "Completed")
        .when(normal.isin("FAILED", "FAILURE", "ERROR"), "Failed")
        .when(F.coalesce(normal, F.lit("")) == "", "N/A")
        .otherwise(F.initcap(normal))
    )


def exact_sum(*parts: Column) -> Column:
    """Sum that is null when any part is null."""
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total
