"""One exception class for each way in which a table operation can fail."""


class TableError(Exception):
    pass


class NotFound(TableError):
    pass


class AlreadyExists(TableError):
    pass


class InvalidArgument(TableError):
    pass


class ConcurrentModification(TableError):
    pass


class Corruption(TableError):
    pass
