"""What the engine says when it won't answer."""


class Refusal(Exception):
    """A statement that can't be answered exactly under the mode in force; ``hint`` names the way out."""

    code = "0A000"

    def __init__(self, why: str, hint: str = ""):
        super().__init__(f"{why}; {hint}" if hint else why)
        self.why, self.hint = why, hint
