"""LaTeX text as Column functions: match, score, clean, convert, check. No Python code runs on the executors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# LaTeX commands and their Unicode letters and signs.
GREEK = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "varepsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "vartheta": "θ", "iota": "ι", "kappa": "κ",
    "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "omicron": "ο", "pi": "π", "varpi": "π", "rho": "ρ", "varrho": "ρ", "sigma": "σ", "varsigma": "ς", "tau": "τ",
    "upsilon": "υ", "phi": "φ", "varphi": "φ", "chi": "χ", "psi": "ψ", "omega": "ω",
    "Gamma": "Γ", "Delta": "Δ", "Theta": "Θ", "Lambda": "Λ", "Xi": "Ξ", "Pi": "Π", "Sigma": "Σ", "Upsilon": "Υ", "Phi": "Φ", "Psi": "Ψ", "Omega": "Ω",
}
SIGNS = {
    "cdot": "*", "times": "*", "div": "/", "pm": "±", "mp": "∓", "leq": "≤", "geq": "≥", "neq": "≠", "approx": "≈", "equiv": "≡", "sim": "∼", "simeq": "≃", "propto": "∝", "infty": "∞",
    "partial": "∂", "nabla": "∇", "int": "∫", "sum": "∑", "prod": "∏", "sqrt": "sqrt", "lim": "lim", "sin": "sin", "cos": "cos", "tan": "tan", "log": "log", "ln": "ln", "exp": "exp",
}
SYMBOLS = GREEK | SIGNS

# Environments of display mathematics, each also starred.
ENVIRONMENTS = ("equation", "align", "gather", "multline")

INLINE = (r"(?<!\$)\$(?!\$)([^$\n]+?)\$(?!\$)", r"\\\((.*?)\\\)")
DISPLAY = (r"\$\$(.*?)\$\$", r"\\\[(.*?)\\\]", *(rf"\\begin\{{{e}{star}\}}(.*?)\\end\{{{e}{star}\}}" for e in ENVIRONMENTS for star in ("", r"\*")))

# What marks a text as mathematics, and the families of patterns.
INDICATOR = r"[\\α-ωΑ-Ω]|\b(?:sin|cos|tan|log|ln|exp|lim|sum|int|sqrt|frac)\b|[∫∑∏∇∂±≤≥≠≈≡∞]|\^[{(]|_[{(]|\d+[a-zA-Z]|[a-zA-Z]\d+"
COMMAND = r"\\[a-zA-Z]+"
OPERATOR = r"[+\-*/^_=<>]"
FAMILIES = {
    "greek_letters": r"(?i)[α-ωΑ-Ω]|\\(?:alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|omicron|pi|rho|sigma|tau|upsilon|phi|chi|psi|omega)",
    "functions": r"(?i)\\?(?:sin|cos|tan|sec|csc|cot|sinh|cosh|tanh|log|ln|exp|sqrt|lim|sum|prod|int)",
    "operators": r"(?i)[+\-*/=<>]|\\(?:pm|mp|times|div|cdot|leq|geq|neq|approx|equiv)",
    "superscripts": r"\^[{(]?[^}\s)]*[})]?",
    "subscripts": r"_[{(]?[^}\s)]*[})]?",
    "fractions": r"(?i)\\(?:frac|dfrac|tfrac)\{[^{}]*\}\{[^{}]*\}",
    "integrals": r"(?i)\\int(?:_[^\\]*)?(?:\^[^\\]*)?",
    "summations": r"(?i)\\sum(?:_[^\\]*)?(?:\^[^\\]*)?",
}
# What the statistics of cleaned formulas count.
FRACTION = r"\\[dt]?frac\{([^{}]+)\}\{([^{}]+)\}"
SCRIPT = {"superscripts": r"\^(\{[^}]*\}|[^{}\s])", "subscripts": r"_(\{[^}]*\}|[^{}\s])"}
FUNCTION = r"\\(sin|cos|tan|sec|csc|cot|sinh|cosh|tanh|log|ln|exp|sqrt|lim)"
# Sized brackets and what they become.
BRACKETS = [
    (r"\left(", "("), (r"\right)", ")"), (r"\left[", "["), (r"\right]", "]"), (r"\left\{", "{"), (r"\right\}", "}"), (r"\left|", "|"), (r"\right|", "|"), (r"\left\langle", "⟨"), (r"\right\rangle", "⟩"),
]

MIN_LENGTH, MAX_LENGTH, MIN_CONFIDENCE = 3, 1000, 0.1


def chain(c: Column, steps: Iterable[tuple[str, str]]) -> Column:
    """Regular-expression replacements, one after the other."""
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def swap(c: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Plain replacements, one after the other."""
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    """All matches of a pattern in which a dot is any character."""
    return F.regexp_extract_all(text, F.lit("(?s)" + pattern), F.lit(group))


def environment(text: Column, name: str) -> Column:
    """Contents of one environment, starred or not."""
    return matches(text, rf"\\begin\{{{name}\*?\}}(.*?)\\end\{{{name}\*?\}}")


def confidence(expression: Column, display: Column | None = None) -> Column:
    """How sure it is that an expression is mathematics, from 0 to 1; display mathematics gets 0.2 more."""
    inner = strip(expression)
    base = 0.3 + F.least(count(expression, INDICATOR) * 0.1, F.lit(0.4)) + F.least(count(expression, COMMAND) * 0.05, F.lit(0.2)) + F.least(count(expression, OPERATOR) * 0.02, F.lit(0.1))
    base = base * F.when(F.length(inner) < 5, 0.8).otherwise(1.0)
    base = base * F.when(expression.rlike(r"^[\d\s]+$") | expression.rlike(r"^[a-zA-Z\s]+$"), 0.5).otherwise(1.0)
    score = F.when(expression.isNull() | (F.length(inner) < MIN_LENGTH), 0.0).otherwise(F.least(base, F.lit(1.0)))
    return score if display is None else F.when(display, F.least(score + 0.2, F.lit(1.0))).otherwise(score)


def preclean(expression: Column) -> Column:
    """White space, comments, font commands, labels and tags out of an expression."""
    steps = [(r"\s+", " "), (r"%.*$", ""), (r"\\text(?:bf|it|rm|sf|tt)\{([^}]*)\}", "$1"), (r"\\(?:bf|it|rm|sf|tt)\s+", ""), (r"\\label\{[^}]*\}", ""), (r"\\tag\{[^}]*\}", "")]
    return strip(chain(strip(expression), steps))


def is_formula(expression: Column, score: Column) -> Column:
    """Length from 3 to 1000, some confidence, neither a number nor one letter."""
    inner = strip(expression)
    return F.length(expression).between(MIN_LENGTH, MAX_LENGTH) & (score >= MIN_CONFIDENCE) & ~inner.rlike(r"^\d+$") & ~inner.rlike("^[a-zA-Z]$")


def symbols_to_unicode(expression: Column) -> Column:
    """Known commands become their signs: one pass over the tokens, not one for each command."""
    known = F.create_map(*(F.lit(x) for k, v in SYMBOLS.items() for x in ("\\" + k, v)))
    tokens = F.regexp_extract_all(expression, F.lit(r"(?s)\\[a-zA-Z]+|[^\\]+|\\"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.startswith("\\"), F.coalesce(F.try_element_at(known, t), t)).otherwise(t)), "")


def fractions(expression: Column) -> Column:
    """Short fractions become (a)/(b), others frac(a, b); the innermost ones only."""
    short = r"\\[dt]?frac\{\s*([^{}\\\s][^{}\\]{0,1}[^{}\\\s]|[^{}\\\s]{1,2})\s*\}\{\s*([^{}\\\s][^{}\\]{0,1}[^{}\\\s]|[^{}\\\s]{1,2})\s*\}"
    return chain(expression, [(short, "($1)/($2)"), (r"\\[dt]?frac\{\s*([^{}]+?)\s*\}\{\s*([^{}]+?)\s*\}", "frac($1, $2)")])


def brackets(expression: Column) -> Column:
    return swap(expression, BRACKETS)


def scripts(expression: Column) -> Column:
    steps = [(rf"{s}\{{([^}}])\}}", f"{m}$1") for s, m in ((r"\^", "^"), ("_", "_"))]
    return chain(expression, [steps[0], (r"\^\{([^}]{2,})\}", "^($1)"), (r"\^\{\}", "^"), steps[1], (r"_\{([^}]{2,})\}", "_($1)"), (r"_\{\}", "_")])


def artifacts(expression: Column) -> Column:
    """Empty braces, spacing commands and stray backslashes go; one space around operators."""
    steps = [(r"\{\}", ""), (r"\\(?:[,;!]|qquad|quad)", " "), (r"\\(?![a-zA-Z])", ""), (r"\s*([+\-*/=<>≤≥≠±])\s*", " $1 "), (r"\s+", " ")]
    return chain(expression, steps)


def clean(expression: Column, unicode: bool = True) -> Column:
    """The whole chain: symbols, fractions, brackets, scripts, artifacts."""
    c = F.regexp_replace(strip(expression), r"\s+", " ")
    if unicode:
        c = symbols_to_unicode(c)
    return strip(artifacts(scripts(brackets(fractions(c)))))


def batch_clean(expression: Column) -> Column:
    """Cleaned, or as it was where that gives nothing."""
    return F.coalesce(clean(expression), expression)


# Commands that become names of the infix language.
INFIX_NAMES = {c: c for c in ("sin", "cos", "tan", "log", "exp", "pi", "alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "sigma", "phi", "omega")} | {"ln": "log", "e": "E"}


def to_infix(expression: Column) -> Column:
    """Cleaned without Unicode, then names for commands; other commands and braces go."""
    steps = [(r"\\frac\{([^{}]+)\}\{([^{}]+)\}", "($1)/($2)"), (r"\\sqrt\{([^{}]+)\}", "sqrt($1)"), *((rf"\\{k}(?![a-zA-Z0-9_])", v) for k, v in INFIX_NAMES.items()), (r"\\[a-zA-Z]+", ""), (r"[{}]", "")]
    return strip(chain(clean(expression, unicode=False), steps))


def unknown_commands(expression: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_except(F.regexp_extract_all(expression, F.lit(COMMAND), F.lit(0)), F.array(*(F.lit("\\" + k) for k in SYMBOLS)))))


def is_mixed(expression: Column) -> Column:
    """Both commands and Unicode signs (or function names, which are values of the table too)."""
    return expression.rlike(COMMAND) & expression.rlike("|".join(sorted({v if v.isalpha() else f"[{v}]" for v in SYMBOLS.values()})))


def is_malformed(expression: Column) -> Column:
    return expression.rlike(r"\\[a-zA-Z]*[^a-zA-Z\\]")


def validator_clean(formula: Column) -> Column:
    """Backslashes go, names are replaced token by token."""
    names = {"cdot": "*", "times": "*", "div": "/", "frac": "", "ln": "log", "e": "E"}
    tokens = F.regexp_extract_all(F.replace(formula, F.lit("\\"), F.lit("")), F.lit("(?s)[a-zA-Z]+|[^a-zA-Z]+"), F.lit(0))
    known = F.create_map(*(F.lit(x) for p in names.items() for x in p))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t)), "")


# Fixed values, in order of their application.
DISPLAY_SIGNS = [("\\forall", "∀"), ("\\exists", "∃"), ("\\in", "∈"), ("\\mathbb{R}", "ℝ"), ("\\mathbb{N}", "ℕ"), ("\\mathbb{Z}", "ℤ"), ("\\mathbb{Q}", "ℚ"), ("\\mathbb{C}", "ℂ"), ("\\frac", ""), ("\\left", ""), ("\\right", ""), ("{", ""), ("}", "")]


def display_statement(statement: Column) -> Column:
    return F.trim(swap(statement, DISPLAY_SIGNS))


def truncated(statement: Column, limit: int = 100) -> Column:
    return F.when(F.length(statement) > limit, F.concat(F.substring(statement, 1, limit - 3), F.lit("..."))).otherwise(statement)


# Words for signs and names, longest match first.
WORDS = {"**": "power", "+": "plus", "-": "minus", "*": "times", "/": "divide", "^": "power", "(": "lparen", ")": "rparen", "=": "equals", "sqrt": "squareroot", "sin": "sine", "cos": "cosine", "tan": "tangent", "exp": "exponential", "log": "logarithm", "pi": "pi", "e": "euler"}


def formula_words(formula: Column) -> Column:
    """A formula as words, for term frequencies: names as whole tokens, signs by the longest match."""
    tokens = F.regexp_extract_all(formula, F.lit(r"\*\*|[a-zA-Z]+|[0-9.]+|\S"), F.lit(0))
    known = F.create_map(*(F.lit(x) for p in WORDS.items() for x in p))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t)), " ")


# Fixed values, in order of their application.
LATEX_SIGNS = [("**", "^"), ("*", r" \cdot "), (">=", r" \geq "), ("<=", r" \leq "), ("!=", r" \neq "), *((x, "\\" + x) for x in ("sqrt", "sin", "cos", "tan", "pi")), ("infinity", r"\infty"), *((x, "\\" + x) for x in ("alpha", "beta", "gamma", "theta", "lambda", "sum")), ("integral", r"\int")]


def infix_to_latex(expression: Column) -> Column:
    return chain(swap(expression, LATEX_SIGNS), [("([0-9A-Za-z_]+)/([0-9A-Za-z_]+)", r"\\frac{$1}{$2}"), ("([0-9A-Za-z_])_([0-9A-Za-z_])", r"$1_{$2}")])


LATEX_MARKS = ("\\", "^", "_", "{", "}", "frac", "sqrt", "sum", "int", "=", "+", "-", "*", "/", "(", ")", "sin", "cos", "tan", "log", "ln", "exp", "pi", "theta", "alpha", "beta", "gamma")


def is_latex_compatible(expression: Column) -> Column:
    found = F.lit(False)
    for m in LATEX_MARKS:
        found = found | F.lower(expression).contains(m)
    return found


def identifier(name: Column) -> Column:
    """Letters, digits and underscores, starting with a letter."""
    c = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    return F.when(c == "", F.lit("unnamed_theorem")).when(c.rlike("^[^a-zA-Z]"), F.concat(F.lit("theorem_"), c)).otherwise(c)


def content_hash(statement: Column, expression: Column) -> Column:
    return F.md5(F.concat_ws(":", statement, expression))


# Words that a search ignores.
STOP_WORDS = "a an and are as at be by for from has he in is it its of on that the to was will with".split()


def search_tokens(text: Column) -> Column:
    """Distinct search terms: lower-case runs of ASCII letters and digits, over two characters, no stop words.

    Runs next to accented letters count, too, so that all engines agree.
    """
    plain = chain(text, [(COMMAND, " "), (r"[{}]", " ")])
    found = F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_except(F.filter(found, lambda t: F.length(t) > 2), F.array(*(F.lit(w) for w in STOP_WORDS)))


def latex_symbols(text: Column) -> Column:
    """Names of commands and their arguments, bases and contents of scripts."""
    parts = [(r"\\([a-zA-Z]+)", 1), (r"\\([a-zA-Z]+)\{([^}]+)\}", 1), (r"\\([a-zA-Z]+)\{([^}]+)\}", 2), (r"([a-zA-Z])_\{([^}]+)\}", 1), (r"([a-zA-Z])_\{([^}]+)\}", 2), (r"([a-zA-Z])\^\{([^}]+)\}", 1), (r"([a-zA-Z])\^\{([^}]+)\}", 2)]
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in parts))
    return F.array_sort(F.array_distinct(F.filter(found, lambda s: s != "")))


def canonical_symbol(symbol: Column) -> Column:
    c = F.lower(F.translate(symbol, "\\{}", ""))
    signs = {"forall": "∀", "exists": "∃", "in": "∈", "mathbbr": "ℝ", "mathbbn": "ℕ", "mathbbz": "ℤ", "mathbbq": "ℚ", "mathbbc": "ℂ"}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in signs.items() for x in p)), c), c)


def strip_comments(source: Column) -> Column:
    """LaTeX comments with their line ends."""
    return F.regexp_replace(source, r"%[^\n]*\n", "")


def text_blocks(source: Column) -> Column:
    """Paragraphs of ten characters or more, without mathematics, commands and braces."""
    c = source
    for p in (*DISPLAY, *INLINE):
        c = F.regexp_replace(c, "(?s)" + p, "")
    c = chain(c, [(r"\\[a-zA-Z]+\{[^}]*\}", ""), (COMMAND, ""), (r"[{}]", "")])
    return F.filter(F.transform(F.split(c, "\n\n"), strip), lambda b: F.length(b) >= 10)
