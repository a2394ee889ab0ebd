"""Stream and batch sources that are read as splits with saved offsets."""

from tidewatch.sources.counting import CountingSource
from tidewatch.sources.empty import EmptySource
from tidewatch.sources.reporting_source import ReportingSource
from tidewatch.sources.split_source import BACKLOG_UNKNOWN, SplitSource

__all__ = ["BACKLOG_UNKNOWN", "CountingSource", "EmptySource", "ReportingSource", "SplitSource"]
