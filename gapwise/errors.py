"""What a request is refused for: a declared code for programs, and a sentence for people in ``str()``."""

CODES = frozenset("""
    bad_driver bad_mechanism bad_param bad_rate bad_target duplicate_columns empty_file empty_table missing_header
    no_columns_left no_numeric_column not_complete parse_error too_many_columns too_many_rows unknown_dataset unknown_method
""".split())


class EngineError(Exception):
    """A refused request. Only declared codes can be raised, so a caller can handle all of them."""

    def __init__(self, code: str, sentence: str) -> None:
        if code not in CODES:
            raise ValueError(f"{code} is not a declared code")
        super().__init__(sentence)
        self.code = code
