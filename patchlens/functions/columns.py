"""Column -> Column functions: text, paths, predicates and the verdict lattice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import VERDICTS, Config
from . import patterns as P

_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(c: Column) -> Column:
    """Without white space at both ends, as Unicode has it."""
    return F.regexp_replace(c, _SPACE, "")


def has_text(c: Column) -> Column:
    """Whether strip() leaves anything: the first such character tells."""
    return c.rlike(r"(?U)[^\s\x1c-\x1f]")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


#: Bytes of the escapes of a quoted path.
_ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquoted(path: Column) -> Column:
    """A path as it is written between quotes (without these): escapes of C and bytes in octal become the UTF-8 text that they spell."""
    parts = F.regexp_extract_all(path, F.lit(r"\\[0-3][0-7]{2}|\\.|[^\\]+|\\"), F.lit(0))

    def spelt(part: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(part, 2, 3), 8, 16), 2, "0")
        named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _ESCAPES.items() for x in kv]), F.substring(part, 2, 1)), F.hex(F.encode(part, "UTF-8")))
        return F.when(part.rlike(r"^\\[0-3][0-7]{2}$"), octal).when(part.startswith("\\"), named).otherwise(F.hex(F.encode(part, "UTF-8")))

    bytes_ = F.unhex(F.array_join(F.transform(parts, spelt), ""))
    return F.when(path.contains("\\"), F.make_valid_utf8(bytes_.cast("string"))).otherwise(path)


def may_have(text: Column, words: tuple[tuple[str, ...], ...]) -> Column:
    """Whether a text has all words of one of these, in any case, or a letter that isn't ASCII and matches one of a to z. If it hasn't, no
    pattern of them matches; that takes a fifth of the pattern's time."""
    has = lambda low: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [low.contains(w) for w in every]) for every in words])
    folded = reduce(lambda a, b: a | b, [text.contains(c) for c in P.FOLDED])
    return folded | F.exists(F.array(F.lower(text)), has)  # one value: lower case is made once


def is_injection(text: Column) -> Column:
    return may_have(text, P.INJECTION_WORDS) & text.rlike(P.INJECTION)


def is_exempt(path: Column, cfg: Config = Config()) -> Column:
    return path.rlike(cfg.exempt_path)


def is_high_risk(path: Column) -> Column:
    return path.rlike(P.HIGH_RISK_PATH)


def is_excluded(path: Column) -> Column:
    return path.rlike(P.EXCLUDED_PATH)


def is_build_output(path: Column) -> Column:
    return path.rlike(P.BUILD_PATH)


def is_lockfile(path: Column) -> Column:
    return basename(path).isin(list(P.MANIFESTS))


def is_off_registry(line: Column) -> Column:
    return line.rlike(P.OFF_REGISTRY)


def is_canonical(host: Column, extra: tuple[str, ...] = ()) -> Column:
    h = F.lower(host)
    return reduce(lambda a, b: a | b, [(h == d) | h.endswith("." + d) for d in (*P.HOSTS, *extra)])


def is_added(line: Column) -> Column:
    """An added line; text that itself starts with ++ is taken for a header."""
    return line.startswith("+") & ~line.startswith("+++")


def keywords(added: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(added, F.lit(P.KEYWORD), F.lit(0)), F.lower))
    return F.when(~may_have(added, P.KEYWORD_WORDS), F.array().cast("array<string>")).otherwise(found)


def priority(path: Column, added: Column) -> Column:
    return F.when(is_high_risk(path), 100).otherwise(0) + 10 * F.size(keywords(added))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def collapse(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def wrap_untrusted(text: Column, escape: bool = True) -> Column:
    """The payload between tags. A closing tag inside it is escaped, or it would end the payload early; escape=False leaves it."""
    body = F.replace(text, F.lit("</untrusted_diff>"), F.lit("<\\/untrusted_diff>")) if escape else text
    return F.concat(F.lit("<untrusted_diff>\n"), body, F.lit("\n</untrusted_diff>"))


def rank_of(verdict: str) -> int:
    return VERDICTS.index(verdict)


def verdict_rank(score: Column, cfg: Config = Config()) -> Column:
    """0 pass, 1 review, 2 block: the lattice on which escalation is a maximum."""
    return F.when(score >= cfg.block, 2).when(score >= cfg.review, 1).otherwise(0)


def verdict(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, VERDICTS)), rank + 1)


def risk_band(score: Column, cfg: Config = Config()) -> Column:
    return F.when(score >= cfg.block, "high risk").when(score >= cfg.review, "medium risk").otherwise("low risk")


def cap_paths(paths: Column, limit: int = 20) -> Column:
    shown = F.array_join(F.transform(F.slice(paths, 1, limit), lambda p: F.concat(F.lit("`"), p, F.lit("`"))), ", ")
    return F.concat(shown, F.when(F.size(paths) > limit, F.concat(F.lit(" …and "), (F.size(paths) - limit).cast("string"), F.lit(" more"))).otherwise(""))


def cell(text: Column) -> Column:
    """For a table cell."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def finding_key(reason: Column) -> Column:
    return F.lower(strip(reason))
