"""listingflow: listing observations reconciled, matched and published with Spark."""
