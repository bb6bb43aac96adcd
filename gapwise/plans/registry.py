"""The methods by name: parameters, clamps, notes, and one ``impute`` for all of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwise.errors import EngineError
from gapwise.functions.missing import (GAPS, Profile, as_key, c, data_columns, has_gaps, normalise_missing,
                                       numeric_columns, profile)
from gapwise.operators import deletion, simple
from gapwise.operators.chained import fit_chained
from gapwise.operators.em import fit_em
from gapwise.operators.knn import impute_knn
from gapwise.operators.multiple import impute_multiple
from gapwise.operators.regression import fit_regression
from gapwise.operators.trees import boosted_trees, impute_trees, random_forest


#: Whole-number parameters by method: default, least value, greatest value (None: no limit).
WHOLE_NUMBERS: dict[str, dict[str, tuple[int, int, int | None]]] = {
    "drop_columns": {"max_missing_pct": (30, 0, 100)},
    "iterative": {"max_iter": (10, 1, None)},
    "em": {"max_iter": (100, 1, None)},
    "knn": {"n_neighbors": (5, 1, None)},
    "random_forest": {"n_estimators": (30, 1, None), "max_iter": (5, 1, None), "max_depth": (10, 1, 30), "max_bins": (64, 2, None)},
    "gradient_boosting": {"max_iter": (5, 1, None)},
    "multiple": {"m": (5, 2, None), "max_iter": (10, 1, None)},
}
NUMBER = re.compile(r"\s*[+-]?\d+\s*")


@dataclass
class Result:
    frame: DataFrame
    notes: list[str] = field(default_factory=list)
    extras: dict = field(default_factory=dict)


@dataclass
class Request:
    """Everything a method may look at. ``cols`` are the usable numeric columns."""
    df: DataFrame
    params: dict
    seed: int
    key: list[str]
    columns: list[str]
    cols: list[str]
    seen: Profile
    notes: list[str]
    track: bool = False
    method: str = ""

    def whole(self, name: str) -> int:
        """A whole-number parameter as WHOLE_NUMBERS declares it; what lies outside its range is moved in, with a note."""
        default, low, high = WHOLE_NUMBERS[self.method][name]
        given = self.params.get(name, default)
        number = given if isinstance(given, (int, float)) else float(given) if isinstance(given, str) and NUMBER.fullmatch(given) else None
        if number is None or not float("-inf") < number < float("inf"):
            raise EngineError("bad_param", f"{name} takes a whole number, not {given!r}.")
        used = max(low, int(number) if high is None else min(int(number), high))
        if used != int(number):
            self.notes.append(f"{name} {given} is out of range; {used} is used.")
        return used

    def flag(self, name: str, default: bool = False) -> bool:
        return bool(self.params.get(name, default))

    def need_key(self) -> None:
        if not self.key:
            raise EngineError("bad_param", "This method needs a row key.")

    def note_text_gaps(self) -> None:
        numeric = set(numeric_columns(self.df, self.key))
        text = [n for n in self.columns if n not in numeric]
        if has_gaps(self.df, text):  # only then are the text columns read to name the ones with gaps
            text = profile(self.df, text).with_gaps(text)
            names = ", ".join(f"'{n}'" for n in text)
            self.notes.append(f"This method works on numeric columns only; gaps in {names} remain.")


def _none(r: Request) -> Result:
    return Result(r.df)


def _listwise(r: Request) -> Result:
    out = deletion.listwise(r.df, r.key)
    if out.isEmpty():
        r.notes.append("No row is left after listwise deletion.")
    return Result(out, extras={"dropped": deletion.listwise_dropped(r.df, r.key)})


def _drop_columns(r: Request) -> Result:
    return Result(deletion.drop_sparse_columns(r.df, r.key, r.whole("max_missing_pct")))


def _pairwise(r: Request) -> Result:
    r.notes.append("Pairwise deletion leaves the data as it is; every correlation uses all available pairs.")
    return Result(r.df, extras=deletion.pairwise_matrices(r.df, r.key))


def _mean_model(r: Request):
    r.note_text_gaps()
    return simple.fit_mean(r.seen, r.cols, r.flag("add_indicator"))


def _median_model(r: Request):
    r.note_text_gaps()
    return simple.fit_median(r.df, r.seen, r.cols, r.flag("add_indicator"))


def _mode_model(r: Request):
    return simple.fit_mode(r.df, r.seen, r.columns, r.flag("add_indicator"))


def _constant_model(r: Request):
    given = str(r.params.get("fill_value", 0.0))
    if not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*", given, re.I):
        raise EngineError("bad_param", f"fill_value takes a number, not {given!r}.")
    r.note_text_gaps()
    return simple.fit_constant(r.seen, r.cols, float(given), r.flag("add_indicator"))


def _regression_model(r: Request):
    stochastic = r.flag("stochastic")
    if stochastic:
        r.need_key()
    if len(r.cols) < 2:
        r.notes.append("Only one numeric column: regression falls back to the mean.")
    return fit_regression(r.df, r.cols, r.seen, stochastic, r.key, r.seed)


def _chained_model(r: Request):
    return fit_chained(r.df, r.cols, r.seen, r.whole("max_iter"))


def _em(r: Request) -> Result:
    rounds = r.whole("max_iter")
    fit_ = fit_em(r.df, r.cols, r.seen, rounds)
    if fit_.iterations > rounds:
        r.notes.append(f"EM did not converge within {rounds} iterations.")
    return Result(fit_.fill.transform(r.df, seen_only=True),
                  extras={"em_iterations": fit_.iterations, "mu": dict(zip(r.cols, fit_.mu.tolist())),
                          "sigma": fit_.sigma, "model": fit_.fill})


def _knn(r: Request) -> Result:
    k = r.whole("n_neighbors")
    weights = r.params.get("weights", "uniform")
    if weights not in ("uniform", "distance"):
        raise EngineError("bad_param", "weights must be 'uniform' or 'distance'.")
    r.need_key()
    return Result(impute_knn(r.df, r.key, r.cols, r.seen, k, weights, r.flag("scale", True)))


def _random_forest(r: Request) -> Result:
    learner = random_forest(r.whole("n_estimators"), r.seed, r.whole("max_depth"), r.whole("max_bins"))
    return Result(impute_trees(r.df, r.key, r.cols, r.seen, learner, r.whole("max_iter")))


def _gradient_boosting(r: Request) -> Result:
    return Result(impute_trees(r.df, r.key, r.cols, r.seen, boosted_trees(r.seed), r.whole("max_iter")))


def _multiple(r: Request) -> Result:
    r.need_key()
    m, rounds = r.whole("m"), r.whole("max_iter")
    runs = impute_multiple(r.df, r.key, r.cols, r.seen, m, rounds, r.seed)
    r.notes.append(f"The frame shows the first of {m} imputed data sets; their spread is in the extras.")
    return Result(runs.frame if r.track else runs.shown(), extras={"m": m, "runs": runs})


def _fitted(model: Callable[[Request], object]) -> Callable[[Request], Result]:
    """A method whose model is a plain ``transform``; the model itself is handed out for new data."""

    def run(r: Request) -> Result:
        fitted = model(r)
        known = {"seen_only": True} if hasattr(fitted, "seen") else {}
        return Result(fitted.transform(r.df, **known), extras={"model": fitted})

    return run


@dataclass(frozen=True)
class Method:
    run: Callable[[Request], Result]
    numeric_only: bool = False


METHODS: dict[str, Method] = {
    "none": Method(_none),
    "listwise": Method(_listwise),
    "drop_columns": Method(_drop_columns),
    "pairwise": Method(_pairwise),
    "mean": Method(_fitted(_mean_model)),
    "median": Method(_fitted(_median_model)),
    "most_frequent": Method(_fitted(_mode_model)),
    "constant": Method(_fitted(_constant_model)),
    "knn": Method(_knn, numeric_only=True),
    "regression": Method(_fitted(_regression_model), numeric_only=True),
    "iterative": Method(_fitted(_chained_model), numeric_only=True),
    "random_forest": Method(_random_forest, numeric_only=True),
    "gradient_boosting": Method(_gradient_boosting, numeric_only=True),
    "em": Method(_em, numeric_only=True),
    "multiple": Method(_multiple, numeric_only=True),
}
_NEEDS_NO_PROFILE = ("none", "listwise", "drop_columns", "pairwise")


def with_gap_list(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Remember per row which of the columns were missing, so that imputed cells need no join later."""
    if not columns:
        return df.withColumn(GAPS, F.array().cast("array<string>"))
    names = F.array(*[F.when(c(n).isNull(), F.lit(n)).otherwise(F.lit("")) for n in columns])
    return df.withColumn(GAPS, F.array_remove(names, ""))


def impute(df: DataFrame, method: str, params: dict | None = None, seed: int = 0,
           key: str | Sequence[str] | None = None, track: bool = False, seen: Profile | None = None) -> Result:
    """Apply one method. With ``track`` the frame carries ``__gaps``, the columns each row missed; ``seen`` is the
    profile of all data columns where the caller has it already."""
    if method not in METHODS:
        raise EngineError("unknown_method", f"Unknown method: {method}")
    chosen, key = METHODS[method], as_key(key)
    df = normalise_missing(df)
    columns, numeric = data_columns(df, key), numeric_columns(df, key)
    notes: list[str] = []
    if method in _NEEDS_NO_PROFILE:
        seen, cols, fillable = Profile(0, {}), [], []
    else:
        read = columns if method == "most_frequent" else numeric  # text columns only where they can be filled
        seen = seen or profile(df, read, numeric)
        cols, fillable = seen.usable(numeric), seen.with_gaps(read)
        notes += [f"Column '{n}' is entirely empty and is not imputed." for n in numeric if n not in cols]
    if track:
        df = with_gap_list(df, fillable)
    request = Request(df, params or {}, seed, key, columns, cols, seen, notes, track, method)
    if chosen.numeric_only:
        if not cols:
            raise EngineError("no_numeric_column", "There is no numeric column with observed values.")
        request.note_text_gaps()
    result = chosen.run(request)
    result.notes = notes + result.notes
    return result


def fit(df: DataFrame, method: str, params: dict | None = None, seed: int = 0,
        key: str | Sequence[str] | None = None):
    """The fitted model of a method that has one (``transform`` fills any frame with the same columns)."""
    model = impute(df, method, params, seed, key).extras.get("model")
    if model is None:
        raise EngineError("unknown_method", f"Method '{method}' has no reusable model.")
    return model
