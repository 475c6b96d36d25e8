"""chronolith: activity-history analytics and training-data preparation on Spark."""
