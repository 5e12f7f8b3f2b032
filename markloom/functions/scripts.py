"""Predicates and rewrites over script text that built-in expressions can do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Substrings that tell of data from outside.
EXTERNAL_DATA = ("sns.load_dataset(", "pd.read_csv(", "pd.read_parquet(", "pd.read_excel(", "pd.read_json(", "np.loadtxt(", "np.genfromtxt(", "requests.", "urllib.", "open(", "Path(")
#: Substrings of scripts that are too complex.
COMPLEX = (
    "animation",
    "FuncAnimation",
    "FFMpegWriter",
    "ArtistAnimation",
    "canvas.new_timer",
    "argparse",
    "ArgumentParser",
    "__main__",
    "multiprocessing",
    "mp.Process",
    "Pipe(",
    "plt.ion",
    "xkcd",
    "usetex=True",
    "projection='3d'",
    'projection="3d"',
    "Axes3D",
    "GridSpec",
    "secondary_y",
    "inset_axes",
    "pie_label(",
    "wedge_labels=",
    "wedge_label_distance=",
    "rotation_mode='xtick'",
    'rotation_mode="xtick"',
    "okabe_ito",
)
#: Calls that make a whole figure.
FIGURE_LEVEL = ("relplot(", "catplot(", "jointplot(", "pairplot(", "displot(", "clustermap(", "FacetGrid(")
SEABORN_MARKS = ("sns.", "seaborn")


def any_of(code: Column, needles: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(code, F.lit(n)) for n in needles))


def external_data(code: Column) -> Column:
    """C1."""
    return any_of(code, EXTERNAL_DATA)


def too_complex(code: Column) -> Column:
    """C2."""
    return any_of(code, COMPLEX)


def supported_seaborn(code: Column) -> Column:
    """Code without seaborn, or without a figure-level call."""
    return ~any_of(code, SEABORN_MARKS) | ~any_of(code, FIGURE_LEVEL)


def collapse_space(text: Column) -> Column:
    """C13, after the comments are gone: every run of Unicode white space is one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fingerprint(normal: Column) -> Column:
    """C14."""
    return F.sha1(normal.cast("binary"))


def ensure_imports(code: Column) -> Column:
    """The imports that the text uses and lacks, in front."""
    has = lambda s: F.contains(code, F.lit(s))
    lines = (("import numpy as np", has("np.")), ("import matplotlib.pyplot as plt", has("plt.") | has("matplotlib")), ("import seaborn as sns", has("sns.")), ("import pandas as pd", has("pd.")))
    head = F.concat_ws("\n", *(F.when(used & ~has(line), F.lit(line)) for line, used in lines))
    return F.when(F.length(head) > 0, F.concat(head, F.lit("\n"), code)).otherwise(code)


def for_execution(code: Column) -> Column:
    """Imports, a backend without a display, and a final show()."""
    code = ensure_imports(code)
    quiet = F.contains(code, F.lit("matplotlib.use('Agg')")) | F.contains(code, F.lit('matplotlib.use("Agg")'))
    code = F.when(quiet, code).otherwise(F.concat(F.lit("import matplotlib\nmatplotlib.use('Agg')\n"), code))
    return F.when(F.contains(code, F.lit("plt.show()")), code).otherwise(F.concat(F.regexp_replace(code, r"(?U)\s+$", ""), F.lit("\nplt.show()\n")))


def extract_code(text: Column) -> Column:
    """C17: the last fenced block, or the text, without a leading role line; null is empty."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    bare = F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?i)^\s*(assistant|model)[^\S\n]*\n", "")
    blocks = F.regexp_extract_all(bare, F.lit(r"```(?:python)?\s*([\s\S]*?)```"), F.lit(1))
    return F.when(F.size(blocks) > 0, strip(F.element_at(blocks, F.greatest(F.size(blocks), F.lit(1))))).otherwise(strip(bare))


def replace_kwarg(code: Column, name: str, value: Column, quoted: bool = False) -> Column:
    """A7, A8, A10, A15 with a given value: every `name=...` gets it."""
    pattern = rf"{name}\s*=\s*" + (r"['\"].*?['\"]" if quoted else r"[\d.]+")
    shown = F.concat(F.lit("'"), value.cast("string"), F.lit("'")) if quoted else value.cast("string")
    return F.when(F.contains(code, F.lit(f"{name}=")), F.regexp_replace(code, F.lit(pattern), F.concat(F.lit(f"{name}="), shown))).otherwise(code)


def fix_colormaps(code: Column) -> Column:
    """A17."""
    return F.regexp_replace(code, r"['\"]petroff\d+['\"]", "'viridis'")
