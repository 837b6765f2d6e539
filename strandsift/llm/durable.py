"""Written tables in the shared folder (see :mod:`strandsift.storage`)."""

from ..storage import drop, durable, folder

__all__ = ["drop", "durable", "folder"]
