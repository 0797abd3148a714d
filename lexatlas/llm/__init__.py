"""Operations of a training-data pipeline over Spark DataFrames."""
