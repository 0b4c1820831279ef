"""plinth: listing-data quality, market analytics and valuation models as Spark jobs."""
