"""What can be wrong with a pattern, said before any plan exists."""


class PatternError(ValueError):
    """kind names the fault; span holds the places in the pattern where it is."""

    def __init__(self, kind: str, pattern: str, start: int, end: int | None = None):
        self.kind, self.pattern, self.span = kind, pattern, (start, start + 1 if end is None else end)
        super().__init__(f"{kind} at {start}\n{self.rendered()}")

    def rendered(self) -> str:
        start, end = self.span
        line = self.pattern.replace("\n", " ")
        return f"  {line}\n  {' ' * start}{'^' * max(1, end - start)}"


class MatchLimitExceeded(RuntimeError):
    """A search outside the JVM took longer than its limit."""
