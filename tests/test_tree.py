import random

import pytest

from spanforge.functions import charset as cs
from spanforge.functions import tree
from spanforge.functions.tree import Alt, At, Back, Chars, Group, Look, Rep, Seq, read

from . import spec
from .test_dialect import SUPPORTED
from .test_iteration import GROUPED, NULLABLE, PLACED, pattern
from .test_patterns import PATTERNS

RANDOM = random.Random(31)
ALL = [*dict.fromkeys([p for p, *_ in SUPPORTED] + PATTERNS + GROUPED + NULLABLE + PLACED + [pattern(RANDOM, 4) for _ in range(150)])]


@pytest.mark.parametrize("text", ALL)
def test_a_printed_tree_reads_as_itself(text):
    one = read(text)
    again = read(one.printed())
    assert again.root == one.root and again.groups == one.groups and again.printed() == one.printed()
    assert [i for _, i in again.names] == [i for _, i in one.names] or len({n for n, _ in one.names}) < one.groups


@pytest.mark.parametrize(("text", "yes", "no"), SUPPORTED)
def test_printed_patterns_match_alike(text, yes, no):
    printed = read(text).printed()
    whole = lambda t: any(e == len(t) for e, _ in spec.ends(read(printed).root, t, 0, {}))
    assert whole(yes) and not whole(no)


def test_nodes():
    one = lambda c: Chars(((ord(c), ord(c)),))
    assert read(r"a(?<n>b|cd)*?\1$").root == Seq((one("a"), Rep(Group(Alt((one("b"), Seq((one("c"), one("d"))))), 1), 0, None, False), Back(1), At("end_line_feed")))
    assert read("(?i)k").root == Chars(((75, 75), (107, 107), (0x212A, 0x212A))) and read("(?<!x)").root == Look(one("x"), False, True)
    assert read("[a-z&&[^b]]").root == Chars(((97, 97), (99, 122))) == read("(?x) [ac-z] # the same").root
    with pytest.raises(AttributeError):
        read("a").root.ranges = ()


def test_fold_and_map():
    t = read(r"(a|bc){2}d?(?=e)")
    least = lambda n, inner: {Chars: lambda: 1, Seq: lambda: sum(inner), Alt: lambda: min(inner), Rep: lambda: inner[0] * n.least, Group: lambda: inner[0]}.get(type(n), lambda: 0)()
    assert t.fold(least) == 2 and sum(isinstance(n, Chars) for n in t.walk()) == 5
    wide = t.map(lambda n: Chars(cs.union(n.ranges, cs.of("0"))) if isinstance(n, Chars) else n)
    assert wide.groups == 1 and read(wide.printed()).root == wide.root == read("([0a]|[0b][0c]){2}[0d]?(?=[0e])").root
    assert tree.read(t.map(lambda n: n.body if isinstance(n, Group) else n).printed()).groups == 0
