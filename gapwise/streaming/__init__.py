from gapwise.streaming.fill import fill_stream

__all__ = ["fill_stream"]
