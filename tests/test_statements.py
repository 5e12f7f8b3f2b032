import builtins
import hashlib
import random

import pytest

from markloom.functions import pycode, statements
from markloom.operators import augment

STATEMENTS = (
    "import numpy as np", "import matplotlib.pyplot as plt", "# it's a part", "x = np.arange(0, 7)", "fig, ax = plt.subplots(1, 2)", "ax.plot(x, x * 3, color='red', alpha=.5)", "ax.plot(\n    x, x,  # why\n)",
    "for i in range(3):\n    ax.scatter(x, x * i, c=\"b\", label=f'l{i}', alpha=1.50)", "(ax.plot)(x, 'a)', \"it's\")", "ax.legend(loc='nowhere')", "ax.hist(x, bins=10, hatchcolor='r')", "s = '''a\nax.plot(1)\n'''",
    "y = x + \\\n    2", "é = 'ü'", "sns.lineplot(x=x, y=x)", "alpha = 3", "def f():\n    global z\n    z = 1", "plot((",
)


def test_variants_are_those_of_whole_scripts():
    """The digest is of variants that were made by reading each script as a whole."""
    rng, told = random.Random(7), hashlib.sha1()
    for path in range(120):
        code = "\n".join(rng.sample(STATEMENTS, rng.randint(2, 7))) + "\n"
        for variant in range(5):
            told.update(repr(augment.augmented(code, random.Random(augment.variant_seed(str(path), variant, 0)))).encode())
    assert told.hexdigest() == "75033e684f2a5fcf873c0bc39ff2c597e510a884"


def test_variants_read_what_changed(monkeypatch):
    """What the compiler reads is little next to what comes out, also for scripts that differ in their numbers and strings."""
    body = "import numpy as np\nimport matplotlib.pyplot as plt\n# part {0}\nx = np.arange(0, {0})\nplt.plot(x, x * {0}, color='red', alpha=0.5)\nplt.title('Brand#{0}')\nplt.show()\n"
    read, plain, made = [], builtins.compile, 0
    monkeypatch.setattr(builtins, "compile", lambda source, *a, **k: read.append(len(source)) or plain(source, *a, **k))
    for i in range(1, 61):
        for variant in range(5):
            made += len(augment.augmented(body.format(i), random.Random(augment.variant_seed(str(i), variant, 0))))
    assert made > 60 * 5 * 150 and sum(read) < made / 10


@pytest.mark.parametrize(
    "code",
    [
        *STATEMENTS,
        "x = 1\nglobal x\n",
        "x = 1\nfrom __future__ import annotations\n",
        "match x:\n    case {1: y, 1: z}: pass\n",
        "match x:\n    case {1: y, 2: z}: pass\n",
        "if x:\n    y = 1\nelse:\n    y = 2\n",
        "else:\n    y = 2\n",
        "x = 1 \\\ny = 2\n",
        "x = '''\ny = 1\n'''\n",
        "x = ''''\n",
        "x = 'a''b'\n",
        "x = \"it's\" + x + \"it's\"\n",
        "x = \"it's\" + ) + \"it's\"\n",
        "x = f'{x +}'\n",
        "x = f'{x + 1}'\n",
        "x = 007\n",
        "x = 7\n",
        "x = 1.real\n",
        "return 1\n",
        "x = '#1f77b4'\n",
        "x = 1 # 'a\ny = 'a'\n",
        "\tx = 1\n",
        "",
    ],
)
def test_compiles_as_a_whole(code):
    for text in (code, code * 2, f"x = 5\n{code}", f"{code}\nx = 'y'"):
        assert statements.compiles(text) == pycode.compiles(text)
        assert statements.apart(text) is None or pycode.parsed(text) is not None
