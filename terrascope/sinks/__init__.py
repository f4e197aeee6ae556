from .buckets import BucketTable
from .releases import YearStore
from .sales_store import (
    add_delivery, compact_year, publish_years, read_cells, read_city_stats, read_prices, read_sales,
    rebuild_statistics, refresh_city_year, replace_sales_year, truncate_year, write_geocodes,
)
from .tables import (
    append_indicators, append_reviews, apply_geocodes, check_year, overwrite_years, read_geocodes, record_geocodes,
    upsert, upsert_boundaries, upsert_cities, upsert_names, with_geocodes,
    write_boundaries, write_dept_stats,
)
