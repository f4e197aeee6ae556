from .delimited import field_count, read_positional
from .indicators import import_indicators, parse_indicators, scan_energy, scan_energy_pages, scan_health
from .json_arrays import read_json_records
from .layout import spread_if_narrow
from .layers import scan_boundaries, scan_countries, union_layers
from .reference import (
    scan_city_mapping, scan_communes_json, scan_departments_json, scan_geocodes, scan_regions_json,
)
from .sales import (
    clean_sales, import_sales, import_sales_zip, lines_from_archives, lines_of_entries, parse_sales, resolve_city,
    scan_sales_csv, scan_sales_positions, zip_entries,
)
