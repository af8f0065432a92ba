"""Templates with ${name} tokens over maps of values.

Templates never go through SQL text, where Spark would substitute ${...} itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def render(template: Column, values: Column, names: list[str] | None = None) -> Column:
    """FN-03: tokens of the values' names replaced, in the order of names (the map's own order if none are given); unknown tokens stay, a
    name without a value in the map stays, and a value of null shows as ``undefined``. Nested values have dotted names.

    The names are folded over the text, so the expression doesn't grow with them.
    """

    def one(text: Column, name: Column) -> Column:
        token, value = F.concat(F.lit("${"), name, F.lit("}")), F.coalesce(values[name], F.lit("undefined"))
        plain = F.replace(text, token, F.when(F.map_contains_key(values, name), value).otherwise(token))
        # a name and a value are text: neither is read as a pattern or as a reference to a group
        quoted = F.concat(F.lit(r"\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        value = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        spaced = F.regexp_replace(text, F.concat(F.lit(r"\$\{\s*"), quoted, F.lit(r"\s*\}")), F.when(F.map_contains_key(values, name), value).otherwise(F.lit("$0")))
        # a pattern is compiled only for a text that holds the name and white space inside braces
        return F.when(~F.contains(text, name), text).when(text.rlike(r"\$\{\s|\s\}"), spaced).otherwise(plain)

    return F.aggregate(F.map_keys(values) if names is None else F.array(*map(F.lit, names)), template, one)


def overridden(default: Column, override: Column) -> Column:
    """SRC-08: one section of the tools: the override's entries, then the default's that it lacks."""
    override = F.coalesce(override, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(default, lambda k, v: ~F.map_contains_key(override, k)), override)


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column whose value is worked out once for each row.

    Spark would write its expression into every lambda that reads it, to run once for each name and template; it doesn't for the single
    element of an exploded array.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def commands(tools: DataFrame, params: dict[str, str], config: dict[str, str]) -> DataFrame:
    """FN-04: name, kind ("command" or "path"), text. tools: one row with maps tools, command, paths.

    Later values win: parameters, configuration, tools, paths. Paths see no other paths.
    """
    known = F.create_map(*[F.lit(x) for kv in (params | config).items() for x in kv]).cast("map<string,string>")
    paths = _held(_held(tools, "base", overridden(known, F.col("tools"))), "rendered", F.transform_values("paths", lambda k, v: render(v, F.col("base"))))
    made = _held(_held(paths, "all", overridden(F.col("base"), F.col("rendered"))), "commands", F.transform_values("command", lambda k, v: render(v, F.col("all"))))
    texts = lambda made, kind: F.coalesce(F.transform(F.map_entries(made), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("text"), F.lit(kind).alias("kind"))), F.array())
    return made.select(F.inline(F.concat(texts("commands", "command"), texts("rendered", "path"))))
