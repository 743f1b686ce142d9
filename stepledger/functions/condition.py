"""Run conditions over a map of environment variables.

The supported expressions are literals, ``env.NAME``, ``== != < <= > >=``, ``&& || !`` and parentheses. Comparisons bind more
strongly than ``&&`` and ``||``, which bind equally; all of them group from the left. ``&&`` and ``||`` give one of their
operands, as in the language that the conditions come from.

A condition is evaluated with built-in expressions only, so there is no list of distinct conditions to bring to the driver.
Every operand is cut out of the text and looked up; what remains is a frame such as ``#0;a!(#1;E#2;)`` of numbered values,
operators and parentheses. Each pass replaces one operation whose operands are values by the value that it gives, until one
value is left. A condition of which more is left was outside these expressions, which is told apart from a false one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRING = r""""(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'"""
_NUMBER = r"-?(?:[0-9]*\.[0-9]+|[0-9]+)"
_NAME = r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*"
_OPERAND = rf"{_STRING}|{_NUMBER}|{_NAME}"
# Operators as one letter each, so that no space can make two of one or one of two.
_LETTERS = {"&&": "a", "||": "o", "==": "E", "!=": "N", "<=": "L", ">=": "G"}
_UNARY = r"!#([0-9]+);"
_COMPARISON = r"#([0-9]+);([ENLG<>])#([0-9]+);"
_LOGIC = r"(?:^|\()#([0-9]+);([ao])#([0-9]+);(?=\z|[)ao])"
_JS_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
_SPACES = " \t\n\x0b\x0c\r"
_MARK = "\u0001"


def _looked_up(token: Column, env: Column) -> Column:
    """A token with its text: that of a quoted string or of a variable, null for anything else."""
    inner = F.regexp_replace(F.substring(token, F.lit(2), F.length(token) - 2), r"\\(.)", "$1")
    text = F.when(token.rlike("^[\"']"), inner).when(
        token.rlike(r"^env\.[^.]+\z"), F.try_element_at(env, F.substring(token, F.lit(5), F.length(token)))
    )
    return F.struct(token.alias("token"), text.alias("text"))


def _value(operand: Column) -> Column:
    """A looked-up token with its kind (string, number, boolean, object or undefined) and number."""
    token, text = operand["token"], operand["text"]
    trimmed = F.btrim(text, F.lit(_SPACES))
    kind = (
        F.when(text.isNotNull(), F.lit("string"))
        .when(token.rlike("^[-.0-9]"), F.lit("number"))
        .when(token.isin("true", "false"), F.lit("boolean"))
        .when(token == "env", F.lit("object"))
        .otherwise(F.lit("undefined"))
    )
    number = (
        F.when(text.isNotNull(), F.when(trimmed == "", F.lit(0.0)).when(trimmed.rlike(_JS_NUMBER), trimmed.try_cast("double")))
        .when(token.rlike("^[-.0-9]"), token.try_cast("double"))
        .when(token.isin("true", "false"), (token == "true").cast("double"))
    )
    return F.struct(kind.alias("kind"), text.alias("text"), number.alias("number"))


def _truthy(value: Column) -> Column:
    return (
        F.when(value["kind"] == "string", value["text"] != "")
        .when(value["kind"].isin("number", "boolean"), value["number"] != 0)
        .otherwise(value["kind"] == "object")
    )


def _compare(left: Column, operator: Column, right: Column) -> Column:
    strings = (left["kind"] == "string") & (right["kind"] == "string")
    bare = left["kind"].isin("undefined", "object") | right["kind"].isin("undefined", "object")
    equal = (
        F.when(bare, left["kind"] == right["kind"])
        .when(strings, left["text"] == right["text"])
        .otherwise(F.coalesce(left["number"] == right["number"], F.lit(False)))
    )

    def ordered(test) -> Column:
        return F.when(strings, test(left["text"], right["text"])).otherwise(
            F.coalesce(test(left["number"], right["number"]), F.lit(False))
        )

    return (
        F.when(operator == "E", equal)
        .when(operator == "N", ~equal)
        .when(operator == "<", ordered(lambda a, b: a < b))
        .when(operator == "L", ordered(lambda a, b: a <= b))
        .when(operator == ">", ordered(lambda a, b: a > b))
        .otherwise(ordered(lambda a, b: a >= b))
    )


def _boolean(holds: Column) -> Column:
    return F.struct(
        F.lit("boolean").alias("kind"), F.lit(None).cast("string").alias("text"), F.when(holds, 1.0).otherwise(0.0).alias("number")
    )


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _reduce(state: Column) -> Column:
    """One operation less, and one pair of parentheses around a value less wherever there is one."""
    text = F.regexp_replace(state["text"], r"\((#[0-9]+;)\)", "$1")

    def found(text: Column) -> Column:
        unary = F.regexp_extract(text, _UNARY, 1)
        compared, logical = ([F.regexp_extract(text, p, k) for k in (1, 2, 3)] for p in (_COMPARISON, _LOGIC))
        binary = [F.when(compared[1] != "", c).otherwise(x) for c, x in zip(compared, logical, strict=True)]
        negated = unary != ""
        return F.struct(
            text.alias("text"),
            F.when(negated, unary).otherwise(binary[0]).alias("left"),
            F.when(negated, F.lit("!")).otherwise(binary[1]).alias("operator"),
            F.when(negated, F.lit("")).otherwise(binary[2]).alias("right"),
        )

    def applied(found: Column) -> Column:
        values, operator = state["values"], found["operator"]
        left, right = (F.get(values, found[side].try_cast("int")) for side in ("left", "right"))
        shown = F.when(operator == "!", F.concat(F.lit("!#"), found["left"], F.lit(";"))).otherwise(
            F.concat(F.lit("#"), found["left"], F.lit(";"), operator, F.lit("#"), found["right"], F.lit(";"))
        )
        # Both ways of a logical operator are values; which one depends on the left one's truth.
        result = (
            F.when(operator == "!", _boolean(~_truthy(left)))
            .when(operator == "a", F.when(_truthy(left), right).otherwise(left))
            .when(operator == "o", F.when(_truthy(left), left).otherwise(right))
            .otherwise(_boolean(_compare(left, operator, right)))
        )
        named = F.concat(F.lit("#"), F.size(values).cast("string"), F.lit(";"))
        return F.when(
            operator != "", F.struct(F.replace(found["text"], shown, named).alias("text"), F.array_append(values, result).alias("values"))
        ).otherwise(F.struct(found["text"].alias("text"), values.alias("values")))

    return _bound(_bound(text, found), applied)


def judge_condition(condition: Column, env: Column) -> Column:
    """``struct<met, supported>``: met without a condition; else its truth, false where it is not supported."""
    tokens = F.regexp_extract_all(condition, F.lit(f"({_OPERAND})"), 1)
    values = F.transform(F.transform(tokens, lambda t: _looked_up(t, env)), _value)
    frame = F.regexp_replace(condition, _OPERAND, _MARK)
    for sign, letter in _LETTERS.items():
        frame = F.replace(frame, F.lit(sign), F.lit(letter))
    pieces = F.split(F.regexp_replace(frame, r"\s+", ""), _MARK)
    number = lambda piece, k: F.when(k == 0, piece).otherwise(F.concat(F.lit("#"), (k - 1).cast("string"), F.lit(";"), piece))
    text = F.array_join(F.transform(pieces, number), "")
    # Every pass uses up an operator or a pair of parentheses, as long as the frame can be reduced.
    passes = F.greatest(F.length(F.regexp_replace(text, r"[^!ao(ENLG<>]", "")), F.lit(1))
    start = F.struct(text.alias("text"), values.alias("values"))
    reduced = F.aggregate(F.sequence(F.lit(1), passes), start, lambda state, _: _reduce(state))
    whole = r"^#([0-9]+);\z"

    def verdict(state: Column) -> Column:
        last = F.get(state["values"], F.regexp_extract(state["text"], whole, 1).try_cast("int"))
        supported = state["text"].rlike(whole) & ~condition.contains(_MARK)
        return F.struct(F.coalesce(supported & _truthy(last), F.lit(False)).alias("met"), F.coalesce(supported, F.lit(False)).alias("supported"))

    always = F.struct(F.lit(True).alias("met"), F.lit(True).alias("supported"))
    return F.when(F.coalesce(condition, F.lit("")) == "", always).otherwise(_bound(reduced, verdict))


def eval_condition(condition: Column, env: Column) -> Column:
    """True without a condition; otherwise the truth of the condition, false if it is not valid or not supported."""
    return judge_condition(condition, env)["met"]
