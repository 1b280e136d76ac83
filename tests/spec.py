"""What the dialect means, by trying everything in order: for tests on short texts."""

from spanforge.functions import dialect as d

WORD = set("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz")


def _in(ranges, c):
    return any(a <= ord(c) <= b for a, b in ranges)


def _at(place, t, i):
    w = lambda k: 0 <= k < len(t) and t[k] in WORD
    return {
        "start": i == 0,
        "end": i == len(t),
        "end_line_feed": i == len(t) or t[i:] == "\n",
        "line_start": i == 0 or t[i - 1] == "\n",
        "line_end": i == len(t) or t[i] == "\n",
        "word": w(i - 1) != w(i),
        "not_word": w(i - 1) == w(i),
    }[place]


def ends(n, t, i, g):
    """(end, groups) of every way to match n at i, the preferred first."""
    match n:
        case d.Chars(ranges, _):
            if i < len(t) and _in(ranges, t[i]):
                yield i + 1, g
        case d.Seq(items):
            if not items:
                yield i, g
            else:
                for j, h in ends(items[0], t, i, g):
                    yield from ends(d.Seq(items[1:]), t, j, h)
        case d.Alt(branches):
            for b in branches:
                yield from ends(b, t, i, g)
        case d.Group(body, k):
            for j, h in ends(body, t, i, g):
                yield j, h | {k: (i, j)}
        case d.Look(body, ahead, negated):
            if ahead:
                found = next(ends(body, t, i, g), None) is not None
            else:
                found = any(j == i for s in range(i + 1) for j, _ in ends(body, t, s, g))
            if found != negated:
                yield i, g
        case d.Back(k):
            if k in g:  # one that took no part matches nowhere
                part = t[slice(*g[k])]
                if t.startswith(part, i):
                    yield i + len(part), g
        case d.At(place):
            if _at(place, t, i):
                yield i, g
        case d.Rep(body, least, most, greedy):

            def more(i, g, done):
                for j, h in ends(body, t, i, g):
                    if j > i:
                        yield from loop(j, h, done + 1)
                    elif greedy and done < max(least, 1):
                        yield j, h  # an iteration of nothing is the last one, while one is owed
                    elif not greedy and done < least:
                        yield from loop(j, h, done + 1)

            def loop(i, g, done):
                can = most is None or done < most
                if done < least:
                    yield from more(i, g, done)
                elif greedy:
                    if can:
                        yield from more(i, g, done)
                    yield i, g
                else:
                    yield i, g
                    if can:
                        yield from more(i, g, done)

            yield from loop(i, g, 0)


def find_all(pattern, t):
    """(start, end, groups) of all matches, in characters."""
    node, at, last, out = d.parse(pattern).node, 0, -1, []
    while at <= len(t):
        hit = next(((s, e, g) for s in range(at, len(t) + 1) for e, g in ends(node, t, s, {})), None)
        if hit is None:
            break
        s, e, g = hit
        if not s == e == last:
            out.append(hit)
        last = e
        at = e if e > s else e + 1
    return out
