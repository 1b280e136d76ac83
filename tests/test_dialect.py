import pytest

from spanforge.functions import PatternError, compile, escape
from spanforge.functions import charset as cs
from spanforge.functions.dialect import parse

from . import spec

SUPPORTED = [
    # pattern, a text that it matches as a whole, one that it doesn't
    (r"(ab)c", "abc", "ab"), (r"[abc]", "b", "d"), (r"a|b", "b", "c"), ("(?x)a b # note", "ab", "a b"), (r"a(?#note)b", "ab", "a"), (r"(?x)[#]", "#", "a"),
    (r"(?i)ab", "AB", "A"), (r"(?i:a)b", "Ab", "AB"), (r"\Qa.b\E", "a.b", "axb"), (r"[\Q.]\E]", "]", "a"), (r"a*", "aaa", "b"), (r"a+", "aa", "b"), (r"ab?", "a", "b"),
    (r"a{2,3}", "aaa", "a"), (r"a{,2}", "aa", "b"), (r"a{}b", "b", "c"), (r"a{,}b", "aaab", "c"), (r"<.+?>", "<a>", "<>"), (r"\a\e\f\n\r\t\v", "\a\x1b\f\n\r\t\v", "a"),
    (r"\x41\x{1F600}B\u{43}\cA", "A\U0001f600BC\x01", "A"), (r"\.\*\-", ".*-", "a"), (r"[\b]", "\b", "b"), (r".", "\r", "\n"), (r"(?s).", "\n", ""), (r"\N", "a", "\n"),
    (r"\d", "7", "٣"), (r"(?u)\d", "٣", "a"), (r"\w", "_", "é"), (r"(?u)\w", "é", "-"), (r"\s", " ", "a"), (r"\S", "a", " "), (r"\h", "　", "᠎"), (r"\H", "᠎", " "),
    (r"a\Rb", "a\r\nb", "a b"), (r"\p{Lu}", "É", "é"), (r"\pL", "é", "1"), (r"\P{Greek}", "a", "α"), (r"\p{Letter}", "a", "1"), (r"\p{greek}", "α", "a"), (r"\p{White_Space}", " ", "a"),
    (r"[[:alpha:]]", "b", "1"), (r"[[:^alpha:]]", "1", "b"), (r"[a-z&&[^aeiou]]", "b", "a"), (r"[a-z--[aeiou]]", "b", "a"), (r"[a-m~~[g-z]]", "z", "h"), (r"[a[0-9]]", "5", "b"), (r"[]a]", "]", "b"),
    (r"[-a]", "-", "b"), (r"[a-]", "-", "b"), (r"[a-\d]", "-", "b"), (r"[^\n]", "a", "\n"), (r"\Aab\z", "ab", "ab\n"), (r"ab\Z", "ab", "abc"), (r"\bab\b", "ab", "abc"), (r"\bx", "x", "y"),
    (r"(?<n>a)\k<n>", "aa", "ab"), (r"(?'n'a)\k'n'", "aa", "ab"), (r"(?P<n>a)(?P=n)", "aa", "ab"), (r"(?<n>a)\k{n}", "aa", "ab"), (r"(?<n>a)|(?<n>b)", "b", "c"), (r"(a)\1", "aa", "ab"),
    (r"a(?=b)b", "ab", "ac"), (r"a(?!b)c", "ac", "ab"), (r"ab(?<=ab)c", "abc", "ab"), (r"a(?<!b)c", "ac", "bc"), (r"(?i)σ", "ς", "a"), (r"(?i)É", "é", "e"), (r"(?i)k", "K", "l"),
]

REJECTED = [
    ("(?^i)a", "InvalidGroup"), ("a*+", "PossessiveQuantifier"), ("a++", "PossessiveQuantifier"), ("a{2,3}+", "PossessiveQuantifier"), ("(?>a)", "AtomicGroup"), ("a**", "NestedQuantifier"), ("a*{2}", "NestedQuantifier"),
    (r"\1", "BackrefNotFound"), (r"(a)\12", "BackrefNotFound"), (r"\o{12}", "InvalidEscape"), (r"\U0001F600", "InvalidEscape"), (r"\N{DASH}", "NamedUnicodeCharacterNotSupported"), (r"[\1]", "EscapeNotAllowedInClass"),
    (r"[\R]", "EscapeNotAllowedInClass"), (r"[\X]", "EscapeNotAllowedInClass"), (r"\V", "InvalidEscape"), (r"\G", "InvalidEscape"), (r"\K", "InvalidEscape"), (r"\b{g}", "InvalidRepetition"), (r"\k1", "InvalidNamedBackref"),
    (r"\k<no>", "UnknownGroupName"), ("(?|a)", "InvalidGroup"), ("(?R)", "InvalidGroup"), ("(?1)", "InvalidGroup"), ("(?(1)a|b)", "InvalidGroup"), ("(*FAIL)", "RepetitionOnNothing"), ("(?)", "InvalidGroup"),
    ("[]", "UnmatchedOpenBracket"), ("[^]", "UnmatchedOpenBracket"), ("[a", "UnmatchedOpenBracket"), ("(a", "UnmatchedOpenParen"), ("a)", "UnmatchedCloseParen"), ("a{3,2}", "InvalidRepetition"), ("a{65536}", "RepetitionTooLarge"),
    ("{", "InvalidRepetition"), ("}", "UnexpectedChar"), ("]", "UnexpectedChar"), (r"\p{Nope}", "UnknownUnicodeProperty"), (r"\p{", "InvalidUnicodeProperty"), ("[[:nope:]]", "UnknownPosixClass"), ("[z-a]", "InvalidClassRange"),
    ("[a-z&&]", "InvalidClassSetOp"), ("[&&a]", "InvalidClassSetOp"), (r"\xZZ", "InvalidHexEscape"), (r"\x{110000}", "InvalidHexEscape"), (r"\u{D800}", "InvalidUnicodeEscape"), (r"\c1", "InvalidControlEscape"), ("*a", "RepetitionOnNothing"),
    ("(?:a{1000}){1000}", "ExpansionTooLarge"), ("(" * 300 + ")" * 300, "NestingTooDeep"), ("(?#a", "UnexpectedEof"), ("\\", "UnexpectedEof"),
]


@pytest.mark.parametrize(("pattern", "yes", "no"), SUPPORTED)
def test_supported_syntax(pattern, yes, no):
    whole = lambda t: any(e == len(t) for e, _ in spec.ends(parse(pattern).node, t, 0, {}))
    assert whole(yes) and not whole(no)


@pytest.mark.parametrize(("pattern", "kind"), REJECTED)
def test_rejected_syntax(pattern, kind):
    with pytest.raises(PatternError) as e:
        compile(pattern)
    assert e.value.kind == kind
    assert "^" in e.value.rendered()


def test_flags_hold_from_where_they_stand():
    whole = lambda p, t: any(e == len(t) for e, _ in spec.ends(parse(p).node, t, 0, {}))
    assert whole("a(?i)b", "aB") and not whole("a(?i)b", "AB")
    assert whole("(?:(?i)a)b", "AB")  # a bare flag in a plain group goes on after it
    assert whole("(?i)ab(?-i:cd)ef", "ABcdEF") and not whole("(?i)ab(?-i:cd)ef", "ABCDEF")


def test_sets():
    a, b = cs.span("a", "m"), cs.span("g", "z")
    assert cs.intersection(a, b) == cs.span("g", "m")
    assert cs.union(cs.difference(a, b), cs.difference(b, a)) == cs.symmetric_difference(a, b)
    assert cs.complement(cs.complement(a)) == a
    assert len(cs.HORIZONTAL) and sum(hi - lo + 1 for lo, hi in cs.HORIZONTAL) == 18
    assert sum(hi - lo + 1 for lo, hi in cs.white_space()) == 25


def test_routes():
    assert compile("abc").route() == "literal" and compile(r"\Aabc\z").route() == "literal"
    assert compile(r"\bthe\b").route() == "native"
    assert compile(r"^(?:a|b)*$").route() == "native"
    assert compile(r'"(?:[^"\\]|\\.)*"').route() == "native" and "*+" in compile(r'"(?:[^"\\]|\\.)*"').explain()
    assert compile(r"(?:a|ab)*c").route() == "outside"
    assert compile(r"(?<=a.*)x").route() == "outside"
    assert compile(r"a*").route("find_all") == compile(r"a*").route() == compile(r"\b|x").route("count") == "native"
    assert compile("(a)|(b)").route("captures") == compile("(a)(b)").route("captures") == "native" and compile("(a*)|(b)").route("captures") == "outside"
    assert compile("(a)(b)?").route("capture_spans") == "native" and compile("(?:x(a))?b").route("capture_spans") == "outside"


def test_names_and_escape():
    p = compile(r"(?P<year>\d+)-(?<month>\d+)")
    assert p.capture_names() == ["year", "month"] and p.group_count == 2 and p.as_str().startswith("(?P")
    assert escape("a.b|c d\n#") == r"a\.b\|c\ d\n\#"
    assert escape("-:<>=!,&~é") == "-:<>=!,&~é"
