"""Plans: operators composed into searches, side tables and publish workflows."""
