"""Errors that operators raise while a plan is built."""


class FathomError(ValueError):
    """A wrong argument."""


class ColumnError(FathomError):
    """A column that is missing or of another type than needed."""


def need_columns(df, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")


def need(ok: bool, what: str) -> None:
    if not ok:
        raise FathomError(what)
