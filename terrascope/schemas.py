"""Table schemas as DDL text. Money stays decimal so that sums are exact."""

REGIONS = ("code STRING, name STRING, population BIGINT, area DOUBLE")
DEPARTMENTS = ("code STRING, name STRING, region_code STRING, population BIGINT, area DOUBLE")
CITIES = (
    "insee_code STRING, name STRING, postal_code STRING, department_code STRING, "
    "population BIGINT, area DOUBLE, latitude DOUBLE, longitude DOUBLE"
)
TRANSACTIONS = (
    "id BIGINT, mutation_id STRING, mutation_date DATE, year INT, mutation_nature STRING, "
    "property_value DECIMAL(15,2), street_number STRING, street_type STRING, postal_code STRING, "
    "city_insee_code STRING, section STRING, plan_number STRING, lot_count INT, property_type STRING, "
    "built_surface DOUBLE, room_count INT, land_surface DOUBLE, "
    "latitude DOUBLE, longitude DOUBLE, geocoded_at TIMESTAMP"
)
INDICATORS = (
    "geographic_level STRING, geographic_code STRING, category STRING, label STRING, "
    "value DOUBLE, unit STRING, year INT"
)
BOUNDARIES = ("geographic_level STRING, geographic_code STRING, name STRING, geometry STRING")
REVIEWS = (
    "id STRING, city_insee_code STRING, content STRING, sentiment_score DOUBLE, "
    "sentiment_label STRING, published_at DATE, author STRING, rating DOUBLE"
)
DEPT_STATS = (
    "department_code STRING, transaction_count BIGINT, avg_price DOUBLE, "
    "avg_price_per_sqm DOUBLE, median_price DOUBLE"
)
CITY_YEAR_STATS = (
    "insee_code STRING, year INT, transaction_count BIGINT, total_price DECIMAL(20,2), "
    "total_residential_surface DOUBLE, updated_at TIMESTAMP"
)
JOB_EVENT = ("type STRING, job STRING, message STRING, at TIMESTAMP")
WEB_VITAL = (
    "name STRING, value DOUBLE, rating STRING, delta DOUBLE, id STRING, "
    "navigationType STRING, path STRING, ts BIGINT"
)

# Property types, indicator categories, geographic levels, event types.
PROPERTY_TYPES = ("MAISON", "APPARTEMENT", "DEPENDANCE", "LOCAL")
CATEGORIES = ("ECONOMY", "POPULATION", "EDUCATION", "ENERGY", "ENVIRONMENT", "INFRASTRUCTURE", "HEALTH")
LEVELS = ("REGION", "DEPARTMENT", "CITY")
EVENT_TYPES = ("STARTING", "RUNNING", "COMPLETED", "FAILED")
