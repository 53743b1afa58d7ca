"""Errors that a plan or the catalog raises at once, on the driver."""


class QuarryError(Exception):
    """Base of all."""


class TableNotFound(QuarryError):
    pass


class ColumnNotFound(QuarryError):
    pass


class ArityMismatch(QuarryError):
    """A row, a partition or a column of another length than the table's."""


class ColumnCollision(QuarryError):
    """Both sides of a join have a column of one name, or a column is asked for twice."""


class NotAnEquiJoin(QuarryError):
    """A hash join's predicate is something else than equality."""


class NoSchema(QuarryError):
    """There are no data to take the columns from."""


class NoSharedFolder(QuarryError):
    """A cluster's session names no folder for what has to be kept."""
