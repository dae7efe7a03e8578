"""Citations: a quote found in normal form and cut from the raw text, and whether it supports what a claim says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions import text as tx

#: White space of any kind, as a class for Java's expressions: the ASCII blanks and these code points.
_CODES = ("00a0", "1680", "2000-200a", "2028", "2029", "202f", "205f", "3000", "feff")
BLANK = r"[\s" + "".join("-".join(f"\\x{{{x}}}" for x in c.split("-")) for c in _CODES) + "]"
_BLANKS = "\t\n\x0b\f\r " + "".join(chr(k) for x in _CODES for k in range(int(x.split("-")[0], 16), int(x.split("-")[-1], 16) + 1))
_WORD = BLANK.replace("[", "[^", 1) + "+"

#: The words and patterns that claims about requirements are judged by.
NORMATIVE = r"\b(?:can(?:not)?|may|must|require[ds]?|shall|should|will)\b"
CRITERION = r"\b(?:given|then|when)\b"
EXCLUDED = r"\b(?:best|delightful|for example|industry-leading|leading|seamless|world(?:'s)?\s+(?:best|most))\b"
VAGUE = r"\b(?:easy|easily|fast|intuitive|quick|quickly|robust|simple|user[- ]friendly|works?\s+well)\b"
SETUP = r"(?:\blocalhost(?::\d+)?\b|^\s*(?:docker(?:\s+compose)?|npm|pnpm|yarn|composer|php\s+artisan)\s+)"
SUPPORT = r"\b(?:contact|email|reach out to)\s+(?:our\s+)?(?:support|team|us)\b"
HEADING = r"\b(?:architecture|example|examples|installation|internal|internals|marketing|setup)\b"
NEGATIVE = r"\b(?:cannot|can't|denied|disabled|disallowed|must\s+not|may\s+not|never|no|not|prohibited|shall\s+not|should\s+not|will\s+not)\b"
ACTIONS = "add approve cancel create delete edit export import install publish refund reject remove run select send start stop submit update view"
MORE_ACTIONS = "learn|set up"
_ACTION = "|".join(ACTIONS.split())
_TWO = r"\b(?:{a})\b[^.!?]*\b(?:and|or)\b[^.!?]*\b(?:{a})\b"
COMPOUND = r"\b(?:can|may|must|shall|should|will)\b[^.!?]*" + _TWO.format(a=_ACTION)
MULTIPLE = _TWO.format(a=f"{_ACTION}|{MORE_ACTIONS}")
LONGEST, LONGEST_PHRASE = 4096, 240


def _has(c: Column, pattern: str) -> Column:
    return c.rlike("(?i)" + pattern.replace(r"\s", BLANK))


def normal(c: Column) -> Column:
    """Words with one space between them."""
    return F.array_join(F.regexp_extract_all(c, F.lit(_WORD), 0), " ")


def locate(raw: Column, quote: Column) -> Column:
    """(start, end) of the first place in raw where the words of quote stand, whatever blanks are between them; null if they do not.

    The words, taken literally, are one pattern with blanks between them and around them; raw is cut once where it is found, and the
    lengths of what is left are the place. One pass over raw and no normal form of it, which is what costs on long texts.
    """
    words = F.regexp_replace(normal(quote), r"[!-/:-@\[-`{-~]", r"\\$0")
    whole = F.concat(F.lit(f"(?<!{_WORD[:-1]})"), F.replace(words, F.lit(" "), F.lit(f"{BLANK}++")), F.lit(f"(?!{_WORD[:-1]})"))  # whole words only
    sides = F.split(raw, F.when(F.length(words) > 0, whole), 2)
    place = F.transform(F.array(sides), lambda x: F.struct(F.length(F.get(x, F.lit(0))).alias("start"), (F.length(raw) - F.length(F.get(x, F.lit(1)))).alias("end"), F.size(x).alias("n")))  # binds sides, so it is read once
    return F.get(F.transform(F.filter(place, lambda x: x["n"] == 2), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))), F.lit(0))


def objections(kind: Column, statement: Column, quote: Column, heading: Column, capability: Column, actor: Column, outcome: Column) -> Column:
    """The names, in order, of what speaks against a claim as one testable statement that its quote supports; empty if nothing does.

    A null statement, quote or capability is empty; a null actor or outcome is not claimed.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    given = {"kind": kind, "s": F.trim(blank(statement), F.lit(_BLANKS)), "quote": blank(quote), "capability": blank(capability), "heading": blank(heading), "actor": actor, "outcome": outcome}
    return _once(given, lambda x: _once(_texts(x), lambda t: _objections(x, t)))


def _once(values: dict[str, Column], f: Callable[[Column], Column]) -> Column:
    """f of a struct of values, each of which is worked out once however often f names it."""
    return F.get(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), f), F.lit(0))


def _texts(x: Column) -> dict[str, Column]:
    """What several objections to a claim look at."""
    texts = {n: tx.support_text(F.coalesce(x[n], F.lit(""))) for n in ("s", "quote", "capability", "actor", "outcome")}
    return texts | {"norms": F.regexp_count(x["s"], F.lit("(?i)" + NORMATIVE)), "several": _has(x["s"], MULTIPLE)}


def _objections(x: Column, t: Column) -> Column:
    s, quote, supported = x["s"], x["quote"], tx.holds(t["quote"], t["s"])
    criterion = x["kind"] == "acceptance_criterion"
    phrase = (x["kind"] == "requirement") & (F.length(s) <= LONGEST_PHRASE) & ~s.rlike(r"[\n;\x{00b7}\x{2022}]") & supported
    found = {
        "too_long": F.length(s) > LONGEST,
        "several_sentences": F.regexp_count(s, F.lit("[.!?]+")) > 1,
        "several_norms": t["norms"] > 1,
        "compound_action": t["several"] & _has(s, COMPOUND),  # every compound action is several
        "several_actions": t["several"],
        "promotion": _has(s, EXCLUDED) | _has(quote, EXCLUDED),
        "vague": _has(s, VAGUE),
        "setup_instruction": _has(s, SETUP),
        "support_contact": _has(s, SUPPORT),
        "excluded_heading": _has(x["heading"], HEADING),
        "no_norm": ~((t["norms"] > 0) | (criterion & _has(s, CRITERION)) | phrase),
        "other_polarity": _has(s, NEGATIVE) != _has(quote, NEGATIVE),
        "statement_unsupported": ~supported,
        "capability_unsupported": ~tx.holds(t["quote"], t["capability"]) | ~tx.holds(t["s"], t["capability"]),
        "actor_unsupported": x["actor"].isNotNull() & ~tx.holds(t["quote"], t["actor"]),
        "outcome_unsupported": x["outcome"].isNotNull() & ~tx.holds(t["quote"], t["outcome"]),
        "outcome_missing": criterion & x["outcome"].isNull(),
    }
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))


def request_path(parts: Column, longest: int = 2048) -> Column:
    """(template, has_query, computed) of an API call's path from its parts, an array of (kind, text): literal text, or a parameter with its
    source expression.

    One fold over the parts: a literal `?` ends the path and so does a parameter whose expression builds a query, unless it stands where a
    segment starts; a parameter is {param}. Without any literal text, or without a segment, there is no template.
    """
    state = F.struct(F.lit("").alias("path"), F.lit(False).alias("ended"), F.lit(True).alias("at_start"), F.lit(False).alias("some"))

    def step(s: Column, p: Column) -> Column:
        literal = p["kind"] == "literal"
        text = F.coalesce(p["text"], F.lit(""))
        query = F.when(literal, F.contains(text, F.lit("?"))).otherwise(F.contains(text, F.lit("?")) & ~s["at_start"])
        kept = F.when(literal, F.split_part(text, F.lit("?"), F.lit(1))).when(query, F.lit("")).otherwise(F.lit("{param}"))
        live = ~s["ended"]
        return F.struct(
            F.when(live, F.concat(s["path"], kept)).otherwise(s["path"]).alias("path"), (s["ended"] | query).alias("ended"),
            (literal & F.endswith(text, F.lit("/"))).alias("at_start"), (s["some"] | (literal & (F.length(text) > 0))).alias("some"),
        )

    done = F.aggregate(parts, state, step)
    segments = F.filter(F.split(done["path"], "/"), lambda x: x != "")
    known = done["some"] & (F.size(segments) > 0)
    template = F.when(known, F.substring(F.concat(F.lit("/"), F.array_join(segments, "/")), 1, longest))
    computed = ~known | F.exists(parts, lambda p: p["kind"] == "parameter")
    return F.struct(template.alias("template"), F.when(done["some"], done["ended"]).otherwise(False).alias("has_query"), computed.alias("computed"))
