"""All queries of the engine; importing it registers them."""
from . import time_queries  # noqa: F401
from . import feature_queries  # noqa: F401
from . import table_queries  # noqa: F401
from . import stream_queries  # noqa: F401
from . import check_queries  # noqa: F401
from . import diagnostic_queries  # noqa: F401
from . import source_queries  # noqa: F401
from . import protocol_queries  # noqa: F401
