"""Free-text questions routed to the query that answers them: a phrase grammar as data, and one matcher.

A phrase is a row of words. ``a|b`` stands for one of several words, ``[a|b]`` for one that may be left out, and a slot takes the
argument: ``{name}`` one word, ``{path}`` a word that begins with a slash, ``{job}`` a word that ends in Job, ``{member}`` a word
with ``::``, ``{rest}`` everything up to the end, ``{verb}`` a request method. Intents are tried in order; the first of whose
phrases one occurs in the question wins. All of it is one pass of column expressions, so a table of questions is routed inside
the JVM. ``ask`` runs the plan of one question with its fallbacks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Below this vector score a semantic answer is refused.
FLOOR = 0.65
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
SLOTS = {
    "{name}": r"(\S+)", "{path}": r"(/\S*)", "{job}": r"(\S*job)(?=\W|$)", "{member}": r"(\S+::\S+)", "{rest}": r"(\S.*)$", "{verb}": f"(?<verb>{'|'.join(VERBS)})",
}
#: What may cling to a word without being part of it.
CLINGING = r"[\s?!.,;:'\"`)\]]+$"
#: Nouns a list can be asked for, in the singular; other number and spelling follow from them.
NOUNS = ("event", "job", "notification", "listener", "observer", "model", "controller", "form request", "policy", "mailable", "resource", "command", "service provider", "cast", "class")


@dataclass(frozen=True)
class Intent:
    """A query, the argument its phrases fill, how sure a match is, and what is tried when it finds nothing."""

    tool: str
    argument: str
    confidence: float
    phrases: tuple[str, ...]
    fallbacks: tuple[str, ...] = ("semantic_search",)
    reading: str = "name"


GRAMMAR = (
    Intent("find_listeners", "event", 0.85, ("listens|listen|listening|subscribes|subscribe to|for {name}", "listeners|listener|subscribers for|of|to|handle|handling {name}", "handles|handle|handling [the] {name} event")),
    Intent("get_request_flow", "uri", 0.85, ("flow for|of {verb} {path}", "flow for|of {path}")),
    Intent("find_handlers", "uri_glob", 0.85, ("what|who|which|controller|action|method handles|serves|answers [the] {rest}", "handler|handlers for|of [the] {rest}"), reading="endpoint"),
    Intent("trace_route", "uri", 0.95, ("{verb} {path}",), ("get_request_flow", "semantic_search")),
    Intent("find_jobs_dispatching", "job", 0.85, ("dispatches|dispatch|queues|queue|enqueues [the] {job}", "{job} [is|gets] dispatched|queued|enqueued")),
    Intent("find_dispatchers", "event", 0.80, ("dispatches|fires|triggers|emits|raises [the] {name}", "dispatchers|dispatcher|emitters of|for {name}", "where is|does|gets {name} dispatched|fired|emitted|raised|triggered", "where {name} [is|gets] dispatched|fired|emitted|raised|triggered")),
    Intent("find_implementations", "interface_fqn", 0.85, ("who|what|which|class|classes implements|implement {name}", "implementations|implementation|implementers|implementors of {name}")),
    Intent("find_callers", "method_fqn", 0.85, ("calls|call|invokes|uses {member}", "callers|caller of {member}")),
    Intent("get_policy_for", "model_fqn", 0.80, ("policy|policies|authorization|authorisation|permissions for|of|on [the] {name}", "authorizes|authorises|guards {name}")),
    Intent("resolve_binding", "abstract", 0.75, ("bound|binding|bindings to|for|of {name}", "resolves|resolve|provides {name}", "container give|gives|return|returns for {name}")),
    Intent("get_model_context", "fqn", 0.85, (), ("describe_class", "semantic_search"), "model class"),
    Intent("describe_class", "fqn", 0.80, (), reading="class"),
    Intent("list_routes", "", 0.90, (), (), "routes"),
    Intent("list_by_kind", "kind", 0.85, (), (), "kind"),
    Intent("describe_flow", "query", 0.75, ("how does|do|is|are {rest}", "walk|take|lead me through [the] {rest}", "what happens when|if|on|after|during|once [the] {rest}", "flow|process of|for|behind [the] {rest}"), reading="process"),
    Intent("explore_entity", "name", 0.80, ("explain|describe|explore [the] {rest}", "tell me about [the] {rest}", "what|who is|are [the] {rest}", "show me [the] {rest}", "show [the] {rest}"), reading="entity"),
)
#: Words that say what a thing is and may follow its name.
PROCESS_ENDS = ("work", "works", "happen", "happens", "function", "run", "flow", "process")
ENTITY_ENDS = ("entity", "class", "model", "service", "controller", "aggregate", "command", "handler", "event", "listener", "job", "notification", "policy", "enum", "interface")


def pattern(phrase: str) -> str:
    """A phrase as a regular expression; its argument is the group ``arg``."""
    out = ""
    for word in phrase.split():
        if word in SLOTS:
            slot = SLOTS[word]
            out += (slot if word == "{verb}" else slot.replace("(", "(?<arg>", 1)) + r"\s+"
        elif word.startswith("["):
            out += f"(?:(?:{word[1:-1]})\\s+)?"
        else:
            out += f"(?:{word})\\s+"
    out = out.removesuffix(r"\s+")
    return r"(?i)(?<!\S)" + (out if phrase.endswith("}") else out + r"(?!\w)")


def _group(phrase: str, name: str) -> str:
    """SQL for what the group takes where the phrase first occurs in ``_q``, else null."""
    order = re.findall(r"\?<(verb|arg)>", pattern(phrase))
    plain = re.sub(r"\?<(?:verb|arg)>", "", pattern(phrase))
    return f"nullif(regexp_extract(_q, r'{plain}', {order.index(name) + 1}), '')" if name in order else "CAST(NULL AS STRING)"


def _bare(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, CLINGING, ""), F.lit(""))


def _one_of(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _endpoint(c: Column) -> Column:
    """A path as it is, anything else as a part of one; a leading request method and a closing "route" say nothing. An event is no endpoint."""
    words = F.split(_bare(c), r"\s+")
    words = F.when(F.array_contains(_one_of(VERBS), F.lower(words[0])) & (F.size(words) > 1), F.slice(words, 2, 1000)).otherwise(words)
    last = F.lower(F.element_at(words, -1))
    words = F.when(last.isin("route", "routes", "endpoint", "endpoints") & (F.size(words) > 1), F.slice(words, 1, F.size(words) - 1)).otherwise(words)
    text = F.array_join(words, " ")
    return F.when(~F.exists(words, lambda w: F.lower(w) == "event"), F.when(text.startswith("/"), text).otherwise(F.concat(F.lit("*"), text, F.lit("*"))))


def _class(words: Column, model: bool) -> Column:
    """The first word that is a class name of several capitalised parts; a model if one of them is Models or Model."""
    named = F.filter(words, lambda w: w.rlike(r"^[A-Z]\w*(\\\\[A-Z]\w*)+(::[A-Za-z_]\w*)?$".replace("\\\\", "\\")))
    first = F.when(F.size(named) > 0, named[0])
    return F.when(F.arrays_overlap(F.split(F.lower(first), r"\\"), F.array(F.lit("models"), F.lit("model"))), first) if model else first


def _kind(lower: Column) -> Column:
    """After "list", "show" or "what", and words that add nothing, a noun with which the question ends."""
    skip = ("all", "the", "every", "some", "me", "us", "my", "our", "available", "are", "there", "exist", "do", "we", "have")
    spoken = F.regexp_replace(F.array_join(F.filter(F.slice(lower, 2, 1000), lambda w: ~w.isin(*skip)), " "), "[-_]", " ")
    table = F.create_map(*[F.lit(x) for noun in NOUNS for form in (noun, noun[:-1] + "ies" if noun.endswith("y") else noun + ("es" if noun.endswith("s") else "s")) for x in (form, noun.replace(" ", "_"))])
    return F.when(lower[0].isin("list", "show", "what", "which"), table[spoken])


def _without_end(c: Column, ends: tuple[str, ...]) -> Column:
    words = F.split(_bare(c), r"\s+")
    return F.when(F.lower(F.element_at(words, -1)).isin(*ends) & (F.size(words) > 1), F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(F.array_join(words, " "))


def _reading(intent: Intent, taken: Column, words: Column, lower: Column) -> Column:
    if intent.reading == "endpoint":
        return _endpoint(taken)
    if intent.reading in ("class", "model class"):
        return _class(words, intent.reading == "model class")
    if intent.reading == "routes":
        return F.when(lower[0].isin("list", "show", "what", "which") & F.array_contains(lower, "routes"), F.lit(""))
    if intent.reading == "kind":
        return _kind(lower)
    if intent.reading == "process":
        return F.nullif(_without_end(taken, PROCESS_ENDS), F.lit(""))
    if intent.reading == "entity":
        name = _without_end(taken, ENTITY_ENDS)
        return F.when(~name.contains(" ") & (F.length(name) >= 3), name)
    return _bare(taken)


def route(questions: DataFrame, query: str = "query") -> DataFrame:
    """``questions`` with tool, arg_name, arg, method, confidence and fallbacks; null and blank questions go to the semantic search."""
    q = F.regexp_replace(F.trim(F.coalesce(F.col(f"_row.`{query}`"), F.lit(""))), r"[\r\n]+", " ")
    rows = questions.select(F.struct(*[F.col(f"`{c}`") for c in questions.columns]).alias("_row")).withColumn("_q", q)
    rows = rows.withColumn("_words", F.transform(F.split("_q", r"\s+"), lambda w: F.regexp_replace(w, CLINGING, "")))
    rows = rows.withColumn("_lower", F.transform("_words", lambda w: F.lower(w)))
    taken = [f"coalesce({', '.join(_group(p, 'arg') for p in x.phrases)}) AS _t{i}" for i, x in enumerate(GRAMMAR) if x.phrases]
    rows = rows.selectExpr("*", *taken)
    rows = rows.withColumns({f"_a{i}": _reading(x, F.col(f"_t{i}") if x.phrases else F.lit(None), F.col("_words"), F.col("_lower")) for i, x in enumerate(GRAMMAR)})
    number = " ".join(f"WHEN _a{i} IS NOT NULL THEN {i}" for i in range(len(GRAMMAR)))
    rows = rows.withColumn("_n", F.expr(f"CASE {number} ELSE {len(GRAMMAR)} END"))

    def of_winner(value: Callable[[int, Intent], str | None], other: str) -> str:
        whens = " ".join(f"WHEN {i} THEN {v}" for i, x in enumerate(GRAMMAR) if (v := value(i, x)) is not None)
        return f"CASE _n {whens} ELSE {other} END"

    def verb(x: Intent) -> str | None:
        spoken = [_group(p, "verb") for p in x.phrases if "{verb}" in p]
        return f"upper(coalesce({', '.join(spoken)}))" if spoken else None

    return rows.selectExpr(
        "_row.*",
        of_winner(lambda i, x: f"'{x.tool}'", "'semantic_search'") + " AS tool",
        of_winner(lambda i, x: f"'{x.argument}'", "'query'") + " AS arg_name",
        of_winner(lambda i, x: f"_a{i}", "_q") + " AS arg",
        of_winner(lambda i, x: verb(x), "CAST(NULL AS STRING)") + " AS method",
        of_winner(lambda i, x: f"{x.confidence}D", "0.4D") + " AS confidence",
        of_winner(lambda i, x: f"'{','.join(x.fallbacks)}'", "''") + " AS fallbacks",
    )


# --- answering --------------------------------------------------------------------------------------------------------


@dataclass
class Answer:
    """What a question led to. ``result`` is None for a refusal (error_code ``no_confident_match``)."""

    tool: str
    confidence: float
    result: DataFrame | None
    alternatives_tried: list[str] = field(default_factory=list)
    error_code: str | None = None


def ask(spark: SparkSession, question: str, tools: dict[str, Callable[[dict[str, str]], DataFrame]], floor: float = FLOOR) -> Answer:
    """Run the plan, then its fallbacks: the first that gives rows wins; a semantic result only with a vector_score of at least ``floor``."""
    plan = route(spark.createDataFrame([(question,)], "query string")).first()
    tried = []
    for i, name in enumerate([plan["tool"], *filter(None, plan["fallbacks"].split(","))]):
        if name not in tools:
            continue
        args = {"query": question} if name == "semantic_search" else {plan["arg_name"]: plan["arg"]} | ({"method": plan["method"]} if plan["method"] else {})
        try:
            result = tools[name](args)
        except (ValueError, KeyError):
            tried.append(name)
            continue
        best = result.agg(F.max("vector_score").alias("v")).first()["v"] if name == "semantic_search" else None
        if (best is not None and best >= floor) if name == "semantic_search" else result.limit(1).count():
            return Answer(name, plan["confidence"] if i == 0 else 0.4 if name == "semantic_search" else plan["confidence"] - 0.15, result, tried)
        tried.append(name)
    return Answer("", 0.0, None, tried, "no_confident_match")
