"""Normal and t distribution as SQL text, evaluated inside the JVM.

Spark's function list has none of them.  Every function here takes and gives text: the arguments are column
names or short expressions, the result goes into ``F.expr``.  Apart from the form of a fold over a sequence
(``Engine``) the text is plain SQL, so that another engine can evaluate it too.  Null in gives null out.

The normal distribution goes by rational approximations of the error function and of the quantile, the
t distribution by the continued fraction of the incomplete beta function, of fixed length, up to
``FRACTION_DF`` degrees of freedom and by an expansion in 1/df beyond.  Relative errors are below 1e-9
(tests compare with independent code).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

#: degrees of freedom up to which the t distribution is summed as a continued fraction
FRACTION_DF = 1_000
#: pairs of terms of that fraction; its need grows with the square root of the degrees of freedom
FRACTION_PAIRS = 100
#: halvings that locate a t quantile
HALVINGS = 60


@dataclass(frozen=True)
class Engine:
    """The two forms that differ between engines.

    ``fold(first, last, by, start, state, item, step)`` folds over a sequence of doubles,
    ``let(name, value, body)`` gives a value a name, so that it is worked out once.
    """

    fold: Callable[[str, str, str, str, str, str, str], str]
    let: Callable[[str, str, str], str]


SPARK = Engine(
    lambda first, last, by, start, state, item, step: (
        f"aggregate(transform(sequence({first}, {last}, {by}), _k -> CAST(_k AS DOUBLE)), {start}, ({state}, {item}) -> {step})"
    ),
    lambda name, value, body: f"element_at(transform(array({value}), {name} -> {body}), 1)",
)


def number(c: float) -> str:
    """A double literal in any engine (plain decimals would be exact decimals)."""
    return f"({c:.17e})" if c < 0 else f"{c:.17e}"


def _poly(x: str, coefficients: Sequence[float]) -> str:
    """Horner's form, the constant first."""
    text = number(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text}*{x} + {number(c)})"
    return text


def _rational(x: str, upper: Sequence[float], lower: Sequence[float]) -> str:
    return f"({_poly(x, upper)}/{_poly(x, lower)})"


# fixed values: the published minimax coefficients of the error function, constants first (W. J. Cody, 1969)
ERF_SMALL = (
    (3.20937758913846947e03, 3.77485237685302021e02, 1.13864154151050156e02, 3.16112374387056560, 1.85777706184603153e-1),
    (2.84423683343917062e03, 1.28261652607737228e03, 2.44024637934444173e02, 2.36012909523441209e01, 1.0),
)
ERFC_MIDDLE = (
    (1.23033935479799725e03, 2.05107837782607147e03, 1.71204761263407058e03, 8.81952221241769090e02, 2.98635138197400131e02,
     6.61191906371416295e01, 8.88314979438837594, 5.64188496988670089e-1, 2.15311535474403846e-8),
    (1.23033935480374942e03, 3.43936767414372164e03, 4.36261909014324716e03, 3.29079923573345963e03, 1.62138957456669019e03,
     5.37181101862009858e02, 1.17693950891312499e02, 1.57449261107098347e01, 1.0),
)
ERFC_TAIL = (
    (6.58749161529837803e-4, 1.60837851487422766e-2, 1.25781726111229246e-1, 3.60344899949804439e-1, 3.05326634961232344e-1, 1.63153871373020978e-2),
    (2.33520497626869185e-3, 6.05183413124413191e-2, 5.27905102951428412e-1, 1.87295284992346725, 2.56852019228982242, 1.0),
)

# fixed values: the published coefficients of the normal quantile, constants first (M. J. Wichura, 1988)
QUANTILE_MIDDLE = (
    (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4,
     6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
     3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
QUANTILE_OUTER = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
     2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
     1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
QUANTILE_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2,
     1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
     1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _erf_small(x: str) -> str:
    """erf for |x| up to 0.46875."""
    return f"({x}*{_rational(f'({x}*{x})', *ERF_SMALL)})"


def _scaled_erfc(y: str) -> str:
    """exp(y*y) erfc(y) for y above 0.46875."""
    w = f"(1/({y}*{y}))"
    tail = f"(({number(1 / math.sqrt(math.pi))} - {w}*{_rational(w, *ERFC_TAIL)})/{y})"
    return f"(CASE WHEN {y} <= 4 THEN {_rational(y, *ERFC_MIDDLE)} ELSE {tail} END)"


def erfc(x: str) -> str:
    """The complementary error function."""
    y = f"abs({x})"
    # far out both the exponential and the rest are 0
    upper = f"(CASE WHEN {y} > 40 THEN {number(0.0)} ELSE exp(-{y}*{y})*{_scaled_erfc(y)} END)"
    return f"(CASE WHEN {y} <= 4.6875e-01 THEN 1 - {_erf_small(x)} WHEN {x} > 0 THEN {upper} ELSE 2 - {upper} END)"


def normal_cdf(z: str) -> str:
    return f"({erfc(f'({z}*{number(-math.sqrt(0.5))})')}/2)"


def normal_pvalue(z: str) -> str:
    """Two-sided."""
    return erfc(f"(abs({z})*{number(math.sqrt(0.5))})")


def log_normal_cdf(z: str) -> str:
    """ln of the normal distribution function; far below zero too, where the function itself underflows."""
    y = f"({z}*{number(-math.sqrt(0.5))})"
    return f"(CASE WHEN {y} > 4.6875e-01 THEN ln({_scaled_erfc(y)}/2) - {y}*{y} ELSE ln({erfc(y)}/2) END)"


def normal_ppf(p: str) -> str:
    """The normal quantile; null outside of 0 to 1 (both excluded)."""
    q, tail = f"({p} - 5e-01)", f"sqrt(-ln(least({p}, 1 - {p})))"
    middle = f"{q}*{_rational(f'({number(0.180625)} - {q}*{q})', *QUANTILE_MIDDLE)}"
    outer = f"(CASE WHEN {tail} <= 5 THEN {_rational(f'({tail} - {number(1.6)})', *QUANTILE_OUTER)} ELSE {_rational(f'({tail} - 5)', *QUANTILE_TAIL)} END)"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({q}) <= 4.25e-01 THEN {middle} ELSE sign({q})*{outer} END)"


# ---------------------------------------------------------------- t distribution


def _gamma_step(a: str, shift: int = 12) -> str:
    """Gamma(a + 1/2) / Gamma(a): Stirling's series at ``a + shift``, brought back by the recurrence."""
    w, h = f"({a} + {shift})", f"({a} + {number(shift + 0.5)})"
    rest = lambda x: f"(({_poly(f'(1/({x}*{x}))', (1 / 12, -1 / 360, 1 / 1260, -1 / 1680))})/{x})"
    log = f"({w} - 5e-01)*ln({h}/{w}) + ln({h})/2 - 5e-01 + {rest(h)} - {rest(w)}"
    back = "*".join(f"(({a} + {i})/({a} + {number(i + 0.5)}))" for i in range(shift))
    return f"(exp({log})*{back})"


def _beta_part(p: str, q: str, x: str, engine: Engine) -> str:
    """The continued fraction of the incomplete beta function without its front factor."""
    even = f"(_m*({q} - _m)*{x}/(({p} + 2*_m - 1)*({p} + 2*_m)))"
    odd = f"(({p} + _m)*({p} + {q} + _m)*{x}/(({p} + 2*_m)*({p} + 2*_m + 1)))"
    inner = engine.fold(str(FRACTION_PAIRS), "1", "-1", number(1.0), "_f", "_m", f"(1 + {even}/(1 - {odd}/_f))")
    return f"(1/({p}*(1 - ({p} + {q})*{x}/(({p} + 1)*{inner}))))"


def t_pvalue(t: str, df: str, engine: Engine = SPARK) -> str:
    """P(|T| >= |t|); null where ``df`` isn't positive."""
    half = number(0.5)
    front = f"({_gamma_step('_a')}*{number(1 / math.sqrt(math.pi))}*exp(_a*ln(_x))*sqrt(_y))"
    lower, upper = f"{front}*{_beta_part('_a', half, '_x', engine)}", f"1 - {front}*{_beta_part(half, '_a', '_y', engine)}"
    fraction = f"(CASE WHEN _x <= (_a + 1)/(_a + 2.5e+00) THEN {lower} ELSE {upper} END)"
    for name, value in (("_y", f"{t}*{t}/({df} + {t}*{t})"), ("_x", f"{df}/({df} + {t}*{t})"), ("_a", f"{df}/2")):
        fraction = engine.let(name, value, fraction)
    # many degrees of freedom: a normal variable with the same tail (G. W. Hill, 1970)
    series = _poly("_r", [(-1) ** k / (k + 1) for k in range(9)])
    log = f"(CASE WHEN _r < 1e-02 THEN _r*{series} ELSE ln(1 + _r) END)"
    bent = "((((-4e-01*_s - 3.3e+00)*_s - 24)*_s - 8.55e+01)/(8e-01*_s*_s + 100 + _b) + _s + 3)/_b + 1"
    expansion = engine.let("_z", f"sqrt(_s)*({bent})", normal_pvalue("_z"))
    for name, value in (
        ("_s", f"({df} - 5e-01)*{log}"), ("_b", f"48*({df} - 5e-01)*({df} - 5e-01)"), ("_r", f"{t}*{t}/{df}"),
    ):
        expansion = engine.let(name, value, expansion)
    return (
        f"(CASE WHEN {df} <= 0 THEN NULL WHEN abs({t}) > 1e+150 THEN {number(0.0)} "
        f"WHEN {df} <= {FRACTION_DF} THEN {fraction} ELSE {expansion} END)"
    )


def t_quantile(p: float, df: str, engine: Engine = SPARK) -> str:
    """The quantile for a constant ``p`` between 0.5 and 1, by halving steps on the logarithm."""
    above = engine.let("_t", "exp(_u)", f"{t_pvalue('_t', df, engine)} > {number(2 * (1 - p))}")
    step = f"(_u + CASE WHEN {above} THEN power(2e+00, 5 - _i) ELSE -power(2e+00, 5 - _i) END)"
    return f"(CASE WHEN {df} > 0 THEN exp({engine.fold('1', str(HALVINGS), '1', number(0.0), '_u', '_i', step)}) END)"
