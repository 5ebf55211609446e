"""Column functions on candidate values: entropy, encoding, context of a name, masks and fingerprints."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds in bits and least lengths by encoding.
ENTROPY_AT = {"base64": 4.5, "hex": 3.8, "jwt": 4.0, "uuid": 3.5, "api_key": 4.2, "generic": 4.0}
LENGTH_AT = {"base64": 16, "hex": 16, "jwt": 36, "uuid": 32, "api_key": 20, "generic": 12}
MAX_LENGTH = 200
# Words in a variable's name, in the order in which they decide.
NAME_CONTEXTS = {
    "api_key": ["api", "key", "apikey", "token"],
    "password": ["pass", "pwd", "password", "passwd"],
    "secret": ["secret", "private", "confidential"],
    "auth": ["auth", "authorization", "bearer"],
    "database": ["db", "database", "sql", "mongo", "redis"],
    "cloud": ["aws", "gcp", "azure", "cloud"],
}
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def computed(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with columns (in place of those of the same name) that are computed once a row.

    A generated row: neither a filter on them nor a column made of them has their expressions put in its place, each as often as it names them.
    """
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__row")).select(*kept, "__row.*")


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def mask(value: Column) -> Column:
    return F.when(F.coalesce(F.length(value), F.lit(0)) <= 8, "****").otherwise(F.concat(F.substring(value, 1, 4), F.lit("..."), F.right(value, F.lit(4))))


def fingerprint(rule_id: Column, path: Column, value: Column) -> Column:
    """Stable id of a finding that doesn't depend on the hidden part of its value."""
    text = F.concat_ws("|", F.coalesce(rule_id, F.lit("")), F.coalesce(path, F.lit("")), mask(value))
    return F.substring(F.sha2(text, 256), 1, 32)


def _characters(value: Column) -> Column:
    return F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character; 0 for empty or null."""

    def bits(text: Column) -> Column:
        def part(n: Column) -> Column:
            share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
            return F.aggregate(_characters(text), F.lit(0.0), lambda total, c: let(share(c), lambda p: total - p * F.log2(p)))

        return F.when(text == "", 0.0).otherwise(let(F.length(text), part))

    # Without let, the value's expression would be computed again for each of its characters.
    return let(F.coalesce(value, F.lit("")), bits)


def printable_entropy(value: Column) -> Column:
    """Entropy over visible ASCII characters only."""
    return entropy(F.regexp_replace(F.coalesce(value, F.lit("")), "[^\\x21-\\x7E]", ""))


def diversity(value: Column) -> Column:
    """Distinct characters as a share of all."""
    n = F.length(value)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.size(_characters(value)) / n)


def encoding_type(value: Column) -> Column:
    v, n = F.trim(value), F.length(F.trim(value))
    return (
        F.when(v.rlike("^[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]*$"), "jwt")
        .when(v.rlike(f"^{UUID}$"), "uuid")
        .when((n >= 16) & v.rlike("^[A-Za-z0-9+/]*={0,2}$") & (n % 4 == 0), "base64")
        .when((n >= 16) & v.rlike("^[0-9a-fA-F]+$"), "hex")
        .when(v.rlike("^[A-Za-z0-9]+$"), "api_key")
        .otherwise("generic")
    )


def name_context(variable: Column, path: Column) -> Column:
    name, path = F.lower(F.coalesce(variable, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    out = F.when(name == "", "unknown")
    for kind, words in NAME_CONTEXTS.items():
        out = out.when(contains_any(name, words), kind)
    return out.when(contains_any(path, ["docker", "k8s", "kubernetes"]), "container").when(contains_any(path, [".env", "config", "settings"]), "config").otherwise("generic")


def by_encoding(encoding: Column, values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), encoding), F.lit(values["generic"]))


def looks_harmless(value: Column) -> Column:
    """Random-looking values that are no credentials: ids, digests, encoded settings, words, paths, placeholders."""
    low, bare = F.lower(value), F.regexp_replace(F.trim(value), "^['\"]+|['\"]+$", "")
    decoded = F.try_to_binary(F.rpad(bare, F.length(bare) + (4 - F.length(bare) % 4) % 4, "="), F.lit("base64")).cast("string")
    settings = bare.startswith("eyJ") & (F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) < 2) & F.coalesce(decoded.rlike("^\\s*[{\\[]"), F.lit(False))
    return (
        bare.rlike(f"^{UUID}$")
        | bare.rlike("(?i)^(sha(1|224|256|384|512)|md5)[-:]")
        | bare.rlike("^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")
        | settings
        | low.isin("password", "username", "token", "secret", "key", "localhost", "example", "test", "demo")
        | low.rlike("\\.(jpg|png|gif|pdf|doc|zip|tar|gz)$")
        | (value.rlike("^https?://") & ~value.contains("@"))
        | value.rlike("^\\$\\{?\\w+\\}?$")
        | low.rlike("^(xxx+|###|...|todo|fixme|changeme)$")
        | ((F.size(_characters(value)) <= 3) & (F.length(value) > 8))
        | value.rlike("^[0-9]+$")
        | value.rlike("^[\\p{L}]+$")
    )


def entropy_confidence(value: Column, encoding: Column, context: Column, bits: Column, variety: Column) -> Column:
    n = F.length(value)
    parts = [
        (bits >= by_encoding(encoding, ENTROPY_AT), 0.4),
        (variety >= 0.7, 0.2),
        ((n >= by_encoding(encoding, LENGTH_AT)) & (n <= MAX_LENGTH), 0.1),
        (encoding.isin("base64", "jwt", "hex"), 0.2),
        (context.isin("api_key", "secret", "auth"), 0.1),
    ]
    total = reduce(lambda a, b: a + b, [F.when(test, points).otherwise(0.0) for test, points in parts])
    return F.least(F.round(total, 6), F.lit(1.0))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[^./\\\\](\\.[^./\\\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def line_of(text: Column, needle: Column) -> Column:
    """The line on which needle first stands in text; 0 if nowhere."""
    at = F.instr(text, needle)
    before = F.substring(text, F.lit(1), at)
    return F.when(at == 0, 0).otherwise(F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def matches_glob(path: Column, glob: str) -> Column:
    """A glob (* and ?) against a path or an end of it that begins at a folder."""
    rx = "(^|/)" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob) + "$"
    return path.rlike(rx)


def normal_url(url: Column, base: Column | None = None) -> Column:
    """Without fragment; relative ones on the base's scheme and host; http:// where no scheme is given."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.concat(F.try_parse_url(base, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(base, F.lit("HOST"))) if base is not None else F.lit(None).cast("string")
    return F.when(u.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), u).when(u.startswith("/"), F.concat(host, u)).otherwise(F.concat(F.lit("http://"), u))
